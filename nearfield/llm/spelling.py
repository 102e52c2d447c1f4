"""Duplicates hidden by formatting differences, by radix partitioning on canonical bytes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.packing import Tokenizer
from nearfield.operators.packed import MAX_BROADCAST_NAMES, few_names, join_texts, known_stretches
from nearfield.sources.tables import materialise, table

_ASCII = re.compile(r"[^a-z0-9]+")
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+")
_SIGNS = re.compile(r"[\W_]+")

#: Buckets are split until they hold at most so many records.
BUCKET_ROWS = 50_000
#: The prefixes to split at a level, at most one for ``BUCKET_ROWS`` records, are sent to
#: every executor up to this number (5e10 records) and joined in a shuffle beyond.
MAX_SPLITS = 1 << 20
EDGE = 8
#: What is left of a name by ``canonical`` is at least a third of its letters and digits.
SLACK = 3


def canonical(text: str) -> str:
    """Letters, digits and combining marks only, in one case and composition."""
    if text.isascii():
        return _ASCII.sub("", text.lower())
    return unicodedata.normalize("NFC", _OTHER.sub("", unicodedata.normalize("NFC", text).casefold()))


def letters(text: str) -> int:
    """Letters and digits of a text, without marks."""
    return len(_SIGNS.sub("", text))


class Trie:
    """A trie over bytes, eight a step; each terminal counts its group: ``[first id, rows]``."""

    def __init__(self):
        self.root: dict = {}

    def add(self, key: bytes, first: int, rows: int) -> list[int]:
        """Count ``rows`` more with this key, the least id among them ``first``."""
        node = self.root
        for at in range(0, len(key), EDGE):
            node = node.setdefault(key[at : at + EDGE], {})
        terminal = node.get(None)
        if terminal is None:
            terminal = node[None] = [first, 0]
        terminal[0] = min(terminal[0], first)
        terminal[1] += rows
        return terminal


def _keys(spark: SparkSession, df: DataFrame, id_column: str, fields: list[str], lists: list[str], known: DataFrame, known_column: str, max_known: int) -> DataFrame:
    """``row_id, rep_id, key, n``: per batch of rows, copies point at the batch's first, and only that has the key and how many they are."""
    rows = df.select(F.col(id_column).cast("long").alias("row_id"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields))).where("row_id IS NOT NULL")
    columns = [f"f{k}" for k in range(len(fields))]
    names = few_names(known, known_column, max_known)
    if names is not None:
        keys = frozenset(filter(None, map(canonical, names)))
        shared, longest = spark.sparkContext.broadcast(keys), SLACK * max(map(len, keys), default=0)
    else:
        every = rows.select(F.explode(F.array(*columns)).alias("text")).where("text IS NOT NULL")
        texts = materialise(spark, every.groupBy("text").agg(F.count("*").alias("n")), "texts")
        texts, longest = known_stretches(spark, texts, known, known_column, canonical, letters, SLACK)
        texts, shared = materialise(spark, texts, "known"), None
        for c in columns:
            rows = join_texts(rows, c, "row_id", texts, f"known_{c}")
    listed = [f in lists for f in fields]

    def canon(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(shared.value if shared else (), longest, canonical, measure=letters)
        part = tokenizer.separator

        def one(text: str, is_list: bool, known) -> str:
            if known is not None:
                tokenizer.known = known
            whole = canonical(text)
            if not part.search(text) or whole in tokenizer.known:
                return whole
            values = sorted(filter(None, map(canonical, tokenizer.split(text))))
            return "\x01".join(values) if is_list or (len(values) > 1 and all(v in tokenizer.known for v in values)) else whole

        for pdf in batches:
            out = []
            found = zip(*(pdf[f"known_{c}"] for c in columns)) if shared is None else None
            for texts in zip(*(pdf[c] for c in columns)):
                sets = [None] * len(columns) if found is None else [frozenset(() if k is None else k) for k in next(found)]
                if any(t is None or not t.strip() for t in texts):
                    out.append(None)
                    continue
                values = sorted(map(one, texts, listed, sets))
                out.append("\x00".join(values).encode("utf-8", "surrogatepass") if all(values) else None)
            res = pd.DataFrame({"row_id": pdf["row_id"], "key": pd.Series(out, index=pdf.index, dtype=object)}).dropna(subset=["key"])
            by = res.groupby("key", sort=False)["row_id"]
            res["rep_id"], res["n"] = by.transform("min"), by.transform("size")
            first = (res["row_id"] == res["rep_id"]) & ~res.duplicated("row_id")
            res["key"], res["n"] = res["key"].where(first, None), res["n"].where(first, 0)
            yield res[["row_id", "rep_id", "key", "n"]]

    return rows.mapInPandas(canon, "row_id long, rep_id long, key binary, n long")


def radix_buckets(spark: SparkSession, reps: DataFrame, bucket_rows: int = BUCKET_ROWS, max_splits: int = MAX_SPLITS) -> DataFrame:
    """Adds ``bucket``, a prefix of ``key``: two bytes, doubled wherever a bucket holds more than ``bucket_rows``.

    Only a bucket of a single key may stay larger. What has to be split at a level is
    joined, so nothing but its number reaches the driver.
    """
    length, longest = 2, reps.agg(F.max(F.length("key"))).first()[0] or 0
    out = reps.withColumn("bucket", F.substring("key", 1, length))
    full = out
    while length < longest:
        large = materialise(spark, full.groupBy("bucket").count().where(F.col("count") > bucket_rows).select(F.col("bucket").alias("large")), "split")
        splits = large.count()
        if not splits:
            break
        length *= 2
        deeper = F.substring("key", 1, length)
        out = out.join(F.broadcast(large) if splits <= max_splits else large, F.col("bucket") == F.col("large"), "left")
        out = out.withColumn("bucket", F.when(F.col("large").isNotNull(), deeper).otherwise(F.col("bucket")))
        full = out.where("large IS NOT NULL").drop("large")
        out = out.drop("large")
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys in whole buckets that follow one another, a trie for each bucket at a time."""
    bucket, trie, reps = None, Trie(), []

    def done() -> pd.DataFrame:
        firsts = [t[0] for _, t in reps]
        out = pd.DataFrame({"rep_id": [r for r, _ in reps], "first_row_id": firsts, "n_rows": [t[1] for _, t in reps]}).astype("int64")
        return out.drop_duplicates("rep_id")

    for pdf in batches:
        for rep, key, n, at in zip(pdf["rep_id"], pdf["key"], pdf["n"], pdf["bucket"]):
            if at != bucket:
                if reps:
                    yield done()
                bucket, trie, reps = at, Trie(), []
            reps.append((rep, trie.add(key, rep, n)))
    if reps:
        yield done()


def spelling_groups(
    spark: SparkSession,
    df: DataFrame,
    id_column: str,
    fields: list[str],
    lists: list[str],
    known: DataFrame,
    known_column: str,
    max_known: int = MAX_BROADCAST_NAMES,
    bucket_rows: int = BUCKET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``(members, groups)``: ``first_row_id, row_id`` of every row with all fields, a first row with itself; and ``first_row_id, n_rows``.

    Rows are copies if their ``fields`` agree when letter case, composition and all
    but letters, digits and marks are disregarded, fields may be exchanged, and a field
    of ``lists`` (or any that consists of ``known`` names) is the list of its values in
    any order. Per batch the copies are collapsed first, so a group of any size reaches
    the shuffle as one record a batch. Those are parted by the bytes of their canonical
    form: buckets of two bytes, each split by further bytes until it fits, then counted
    in a trie per bucket, one bucket at a time, whose terminals hold the first row and
    the number of rows of their group. Joining back is by the batch's first row, of
    which a batch has at most its rows. Up to ``max_known`` names go to the executors;
    more are joined with the stretches of texts that occur.

    Rows with a null or empty field (also one without a letter or digit) or a null id
    are no case; a repeated id is a repeated row and counts as one more; an empty table
    gives none; further columns are not read.
    """
    rows = materialise(spark, _keys(spark, df, id_column, fields, lists, known, known_column, max_known), "canon")
    reps = rows.where("key IS NOT NULL").select("rep_id", "key", "n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), reps.count() // (4 * bucket_rows) + 1)
    cut = radix_buckets(spark, reps, bucket_rows).repartition(parts, "bucket").sortWithinPartitions("bucket")
    first = materialise(spark, cut.mapInPandas(_count, "rep_id long, first_row_id long, n_rows long"), "counted")
    members = rows.select("row_id", "rep_id").join(first.select("rep_id", "first_row_id"), "rep_id").select("first_row_id", "row_id")
    return members, first.where("rep_id = first_row_id").select("first_row_id", "n_rows")


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spelling_groups(
        spark, table(spark, sf_dir, "spotify_tracks"), "row_id", ["track_name", "artists", "album_name"], ["artists"], table(spark, sf_dir, "artist_ref"), "artist_name"
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracks(spark, sf_dir)[0].where("row_id <> first_row_id").select("first_row_id", F.col("row_id").alias("copy_row_id"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per group of copies, with how many rows it had, as the tries counted."""
    return _tracks(spark, sf_dir)[1]


QUERIES = {"p4_found": p4_found, "p4_records": p4_records}
SQL: dict[str, str] = {}
