"""Texts about moods as query vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import mood
from nearfield.operators.normalize import Normalizer


def _lexicon(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(mood.lexicon(), "term string, feature string, target double, weight double"))  # fixed


def available_moods(spark: SparkSession) -> DataFrame:
    return _lexicon(spark).select("term").distinct().orderBy("term")


def matched_terms(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """``qid, place, term, written`` of ``texts(qid, text)``: a row each time a term fires, and the words that fired it.

    First the phrases found anywhere in the lower-cased text, in their listed order,
    then every word of a to z that is a term, each time it occurs. A phrase's words may
    fire again. A null text fires nothing.
    """
    lower = F.lower(F.coalesce("text", F.lit("")))
    phrases = F.array(*(F.when(lower.contains(p), F.struct(F.lit(t).alias("term"), F.lit(p).alias("written"))) for p, t in mood.ALIASES.items()))
    words = F.transform(F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0)), lambda w: F.struct(w.alias("term"), w.alias("written")))
    terms = _lexicon(spark).select("term").distinct()
    fired = texts.select("qid", F.posexplode(F.concat(phrases, words)).alias("place", "x")).where("x IS NOT NULL").select("qid", "place", "x.term", "x.written")
    return fired.join(F.broadcast(terms), "term", "left_semi").select("qid", "place", "term", "written")


def fixed(column: str, digits: int) -> Column:
    """A number from 0 up to 8 with digits after the point, rounded by its exact binary value, halves to even.

    Formatting by the decimal text of a double, as the JVM does, rounds 0.825 up though
    the double lies below; so multiples of 2**-60 are counted in whole numbers. Each
    ``transform`` binds a value that is used more than once.
    """
    unit, half, tens = f"CAST('{1 << 60}' AS DECIMAL(20,0))", f"CAST('{1 << 59}' AS DECIMAL(20,0))", 10**digits
    scaled = f"CAST(floor(`{column}` * CAST('{1 << 60}' AS DOUBLE)) AS DECIMAL(20,0)) * CAST({tens} AS DECIMAL(4,0))"
    parts = f"transform(array({scaled}), x -> struct(CAST(floor(x / {unit}) AS BIGINT) AS whole, x AS x))"
    rests = f"transform({parts}, p -> struct(p.whole AS whole, CAST(p.x - CAST(p.whole AS DECIMAL(18,0)) * {unit} AS DECIMAL(20,0)) AS rest))"
    cents = f"transform({rests}, p -> p.whole + CASE WHEN p.rest > {half} OR (p.rest = {half} AND p.whole % 2 = 1) THEN 1 ELSE 0 END)"
    return F.expr(f"transform({cents}, c -> concat(CAST(c DIV {tens} AS STRING), '.', lpad(CAST(c % {tens} AS STRING), {digits}, '0')))[0]")


def _filled(template: str, **values: Column) -> Column:
    """A text template with columns in its places; what follows a colon there is dropped."""
    parts = [F.lit(piece) if not at % 2 else values[piece.split(":")[0]] for at, piece in enumerate(template.replace("{", "\x00").replace("}", "\x00").split("\x00"))]
    return F.concat(*parts)


def _asked(spark: SparkSession, texts: DataFrame, fired: DataFrame) -> DataFrame:
    """``qid, text`` and per feature the weighted mean of what the fired terms ask, added up in the order they fired; null if none does."""
    listed = F.array_sort(F.collect_list(F.struct("place", "target", "weight")))
    asked = fired.join(_lexicon(spark), "term").groupBy("qid", "feature").agg(listed.alias("asks"))
    value = F.expr("aggregate(asks, 0D, (s, x) -> s + x.target * x.weight) / aggregate(asks, 0D, (s, x) -> s + x.weight)")
    wide = asked.select("qid", "feature", value.alias("value")).groupBy("qid").pivot("feature", mood.FEATURES).agg(F.first("value"))
    return texts.select("qid", "text").join(wide, "qid", "left")


def _target(feature: str) -> Column:
    return F.coalesce(F.col(feature), F.lit(mood.NEUTRAL[feature]))


def translate(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """``qid, text, matched, raw_vector, targets, constrained, explanation``.

    A feature's target is the weighted mean of what the fired terms ask, or neutral.
    ``matched`` are the phrases and words that fired, each once.
    """
    fired = matched_terms(spark, texts)
    by_place = F.array_sort(F.collect_list(F.struct("place", "written")))
    names = fired.groupBy("qid").agg(F.array_distinct(F.transform(by_place, lambda x: x["written"])).alias("matched"))
    rows = _asked(spark, texts, fired).join(names, "qid", "left")
    bits = []
    for f in mood.EXPLAINED:
        shown = F.bround(F.col(f), 0).cast("long").cast("string") if f == "tempo" else fixed(f, 2)
        bits.append(F.when(F.col(f).isNotNull(), _filled(mood.TEMPO_TEXT if f == "tempo" else mood.FEATURE_TEXT, feature=F.lit(f), value=shown)))
    quoted = F.expr("array_join(transform(matched, t -> concat('\\'', t, '\\'')), ', ')")
    told = _filled(mood.MATCHED_TEXT, terms=quoted, targets=F.concat_ws(", ", *bits))
    pairs = lambda of: F.map_from_arrays(F.array(*map(F.lit, mood.FEATURES)), F.array(*(of(f) for f in mood.FEATURES)))
    return rows.select(
        "qid", "text", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), F.array(*map(_target, mood.FEATURES)).alias("raw_vector"),
        pairs(_target).alias("targets"), pairs(lambda f: F.col(f).isNotNull()).alias("constrained"),
        F.when(F.col("matched").isNull(), F.lit(mood.UNMATCHED_TEXT)).otherwise(told).alias("explanation"),
    )


def query_vectors(spark: SparkSession, texts: DataFrame, normalizer: Normalizer) -> DataFrame:
    """``qid, qvec``: the texts' vectors in the corpus's normalised space."""
    raw = _asked(spark, texts, matched_terms(spark, texts)).select("qid", F.array(*map(_target, mood.FEATURES)).alias("raw_vector"))
    return raw.select("qid", normalizer.transform_vector(F.col("raw_vector")).cast("array<float>").alias("qvec"))
