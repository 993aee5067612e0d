"""Batch quoting: requested services against a price catalogue.

requests: (quote_id, services array<string>, months int, plan string); catalogue: (servicio, precio_usd,
plazo_entrega, cat_ord), cat_ord being the position in the price list.
"""

from pyspark.sql import DataFrame, functions as F

from folioquery import constants as K
from folioquery.functions.prices import price_is_from, price_value
from folioquery.functions.text import fold_accents
from folioquery.operators.containment import first_contained, first_containing
from folioquery.session import checkpoint


def _names(catalogue: DataFrame) -> DataFrame:
    """Distinct folded service names with their first position: all that a match can need."""
    named = catalogue.where("servicio IS NOT NULL").groupBy("servicio").agg(F.min("cat_ord").alias("ord"))
    return named.groupBy(fold_accents(F.col("servicio")).alias("name")).agg(F.min("ord").alias("ord"))


def _entries(catalogue: DataFrame) -> DataFrame:
    """Entries with their price as text: only prices of matched entries are parsed."""
    return catalogue.select(F.col("cat_ord").alias("ord"), F.col("servicio").alias("service"),
                            F.col("precio_usd").alias("price_text"), F.col("plazo_entrega").alias("delivery"))


def request_lines(requests: DataFrame) -> DataFrame:
    return requests.select("quote_id", F.posexplode("services").alias("line", "requested"))


def _texts(lines: DataFrame) -> DataFrame:
    """(requested, request): each distinct text and how it is folded, written down once. Otherwise every use reads all lines
    again, and where only ``request`` is used, Spark drops the first distinct and folds line by line."""
    return checkpoint(lines.select("requested").distinct().withColumn("request", fold_accents(F.col("requested"))))


def quote_lines(lines: DataFrame, catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """Each requested line with the first catalogue entry that contains it or is contained in it.

    Returns (quote_id, line, requested, service, price, is_from, delivery), service NULL if unmatched.
    Matching runs once per distinct request text.
    """
    texts, names = _texts(lines), checkpoint(_names(catalogue))
    asked = texts.select("request").distinct()
    first = (first_containing(asked, names).unionByName(first_contained(asked, names))
             .groupBy("request").agg(F.min("ord").alias("ord")))
    matched = first.join(_entries(catalogue), "ord").select(
        "request", "service", price_value(F.col("price_text"), strict).alias("price"),
        price_is_from(F.col("price_text")).alias("is_from"), "delivery")
    priced = texts.join(matched, "request").drop("request")
    return lines.join(priced, "requested", "left").select(
        "quote_id", "line", "requested", "service", "price", "is_from", "delivery")


def maintenance_lines(requests: DataFrame, catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """Maintenance of every request with months > 0: (quote_id, requested, plan_service, monthly, months, cost)."""
    name = F.concat(F.lit(K.MAINTENANCE), F.coalesce("plan", F.lit(K.DEFAULT_PLAN)))
    wanted = requests.where("months > 0").select("quote_id", "months", name.alias("requested"))
    texts = _texts(wanted)
    first = first_containing(texts.select("request").distinct(), _names(catalogue))
    plans = texts.join(first, "request").join(_entries(catalogue), "ord").select(
        "requested", F.col("service").alias("plan_service"), price_value(F.col("price_text"), strict).alias("monthly"))
    return wanted.join(plans, "requested", "left").select(
        "quote_id", "requested", "plan_service", "monthly", "months",
        (F.col("monthly") * F.col("months")).alias("cost"))


def quote_totals(quote_ids: DataFrame, lines: DataFrame, maintenance: DataFrame) -> DataFrame:
    """(quote_id, subtotal, total, has_from): sums over services, then with maintenance."""
    sums = lines.groupBy("quote_id").agg(
        F.sum("price").alias("subtotal"), F.bool_or("is_from").alias("has_from"))
    return (quote_ids.join(sums, "quote_id", "left").join(maintenance.select("quote_id", "cost"), "quote_id", "left")
            .select("quote_id", F.coalesce("subtotal", F.lit(0.0)).alias("subtotal"),
                    (F.coalesce("subtotal", F.lit(0.0)) + F.coalesce("cost", F.lit(0.0))).alias("total"),
                    F.coalesce("has_from", F.lit(False)).alias("has_from")))


def unmatched_lines(lines: DataFrame, maintenance: DataFrame) -> DataFrame:
    """(quote_id, line, requested) without a catalogue entry; maintenance comes after the services."""
    return (lines.where("service IS NULL").select("quote_id", "line", "requested")
            .unionByName(maintenance.where("plan_service IS NULL")
                         .select("quote_id", F.lit(2**31 - 1).alias("line"), "requested")))


def quotes(requests: DataFrame, catalogue: DataFrame, strict: bool = True) -> DataFrame:
    """One nested quote per request, also for one without services; parts that do not apply are NULL.

    Service and maintenance lines meet in one aggregation per quote.
    """
    services = quote_lines(request_lines(requests), catalogue, strict).withColumn("kind", F.lit(0))
    plans = maintenance_lines(requests, catalogue, strict).withColumn("kind", F.lit(1))
    said, planned = F.col("service").isNotNull(), F.col("plan_service").isNotNull()
    found = services.unionByName(plans, allowMissingColumns=True).groupBy("quote_id").agg(
        F.sort_array(F.collect_list(F.when(said, F.struct("line", "service", "price", "is_from", "delivery")))).alias("ls"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("subtotal"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("added"),
        F.bool_or("is_from").alias("has_from"),
        F.max(F.when(planned, F.struct(F.col("plan_service").alias("plan"), "monthly", "months", F.col("cost").alias("total")))).alias("maintenance"),
        F.sort_array(F.collect_list(F.when(~said & ~planned, F.struct("kind", "line", "requested")))).alias("missing"))
    lines = F.transform("ls", lambda x: F.struct(x["service"].alias("service"), x["price"].alias("price"),
                                                 x["is_from"].alias("is_from"), x["delivery"].alias("delivery")))
    quoted = found.select("quote_id", lines.alias("lines"), "subtotal", "maintenance", (F.col("subtotal") + F.col("added")).alias("total"),
                          "has_from", F.when(F.size("missing") > 0, F.col("missing")["requested"]).alias("unmatched"))
    return (requests.select("quote_id").join(quoted, "quote_id", "left").select(
        "quote_id", F.coalesce("lines", F.array().cast(dict(quoted.dtypes)["lines"])).alias("lines"),
        F.coalesce("subtotal", F.lit(0.0)).alias("subtotal"), "maintenance", F.coalesce("total", F.lit(0.0)).alias("total"),
        F.lit(K.PAYMENT_TERMS).alias("payment_terms"), F.when(F.col("has_from"), F.lit(K.FROM_PRICE_NOTE)).alias("note"), "unmatched"))
