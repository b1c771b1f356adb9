"""URL filters: domain and path rules first, a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, table

#: The rules of the query's contract: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

DIMS, GRAMS = 1 << 14, (3, 4)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Without "://", or for null, both are empty."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(whole.contains("://"), F.substr(whole, F.instr(whole, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), after


def with_parts(urls: DataFrame, column: str = "url") -> DataFrame:
    """Adds host and path to a table of urls."""
    host, path = url_parts(urls[column])
    return urls.withColumns({"host": host, "path": path})


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, as text, and its verdict; null where none fits."""
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longer rules are asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        named, verdict = F.when(fits, F.lit(host + path)).otherwise(named), F.when(fits, F.lit(said)).otherwise(verdict)
    return named, verdict


def hashed_grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the character n-grams of each host and of each path, hashed apart from one another."""
    rows, slots = [], []
    for salt, texts in ((0x9E3779B97F4A7C15, hosts), (0xC2B2AE3D27D4EB4F, paths)):
        raw = np.frombuffer(b"".join(b"^" + t.encode() + b"$" for t in texts), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(t.encode()) + 2 for t in texts])
        for n in GRAMS:
            if len(raw) < n:
                continue
            whole = owner[: len(raw) - n + 1] == owner[n - 1 :]
            h = np.full(len(raw) - n + 1, np.uint64(salt) + np.uint64(n))
            for k in range(n):
                h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            rows.append(owner[: len(raw) - n + 1][whole])
            slots.append((h[whole] % np.uint64(DIMS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(slots)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit_urls(hosts: list[str], paths: list[str], blocked: list[bool], rounds: int = 60, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression on n-gram presence scaled to unit length."""
    y = np.array(blocked, float)
    weights = np.zeros(DIMS + 1)
    if len(y) == 0:
        return weights
    row, slot = hashed_grams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh the same
    speed = np.full(DIMS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, weights[slot], minlength=len(y)) * scale + weights[-1]
        slip = (1 / (1 + np.exp(-z)) - y) * share
        step = np.append(np.bincount(slot, (slip * scale)[row], minlength=DIMS), slip.sum())
        step[:-1] += decay * weights[:-1]
        speed += step * step
        weights -= rate * step / np.sqrt(speed) * 0.1
    return weights


def score_urls(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Log odds that each url should be blocked."""
    row, slot = hashed_grams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts))))
    return np.bincount(row, weights[slot], minlength=len(hosts)) * scale + weights[-1]


def labelled_urls(judged: DataFrame, max_labelled: int) -> DataFrame:
    """The small labelled table: at most max_labelled distinct (host, path), the rules' verdicts as labels."""
    known = judged.where(F.col("verdict").isNotNull()).select("host", "path", (F.col("verdict") == "block").alias("blocked")).distinct()
    return bounded(known, max_labelled)


def bounded(labelled: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by hash: the same ones however the table is dealt."""
    return labelled.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(most)


def filter_urls(urls: DataFrame, column: str = "url", rules=RULES, labelled: DataFrame | None = None, max_labelled: int = 4000, threshold: float = 0.5) -> DataFrame:
    """All columns of ``urls`` with host, path, rule, verdict and score (probability of block; null where a rule decides).

    ``labelled`` (host, path, blocked; rows with nulls are left out) trains the model, at most max_labelled rows of it by
    hash order (a bounded sample; every url is judged). By default the urls that a rule decides are the labelled table:
    weak labels, so the model then carries the rules' judgement over to hosts and paths that no rule covers. A model without labels, or with
    one class, allows unless its bias says otherwise. A null or malformed url has empty host and path and is
    judged by the model. Repeated urls get the same verdict. An empty table gives an empty table. Columns named
    host, path, rule, verdict or score in the input are replaced.
    """
    urls = urls.drop("host", "path", "rule", "verdict", "score")
    named, verdict = rule_columns(rules)
    judged = with_parts(urls, column).withColumn("rule", named).withColumn("verdict", verdict)
    given = labelled_urls(judged, max_labelled) if labelled is None else bounded(labelled.select("host", "path", "blocked").dropna(), max_labelled)
    sample = sorted(given.collect(), key=lambda r: (r["host"], r["path"], r["blocked"]))
    weights = fit_urls([r["host"] for r in sample], [r["path"] for r in sample], [bool(r["blocked"]) for r in sample])

    def judge(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-score_urls(weights, batch.column("host").to_pylist(), batch.column("path").to_pylist())))
            open_ = pa.compute.is_null(batch.column("verdict"))
            said = pa.compute.if_else(open_, pa.array(np.where(p >= threshold, "block", "allow").tolist(), pa.string()), batch.column("verdict"))
            score = pa.compute.if_else(open_, pa.array(p), pa.scalar(None, pa.float64()))
            keep = [n for n in batch.schema.names if n != "verdict"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), said, score], names=[*keep, "verdict", "score"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema.fields if f.name != "verdict"]
    return judged.mapInArrow(judge, ", ".join([*kinds, "verdict string", "score double"]))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op3_url_filter": op3_url_filter}
SQL: dict = {}
