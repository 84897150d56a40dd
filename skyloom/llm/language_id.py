"""Language identification by Bayesian fusion of four kinds of evidence.

The languages are those that at least ``LEAST_SHARE`` of the pages with a
declaration declare (a grouped aggregate; so at most ``1 / LEAST_SHARE`` of them),
or the ones given.  For each page the log-posterior of a language adds up

* the text: naive Bayes over hashed words of the visible text, whose counts per
  declared language (where the address does not contradict it) are one table of
  fixed size, summed over all pages; long
  texts are tempered to ``EFFECTIVE`` independent words;
* the markup: the language that ``<html lang>`` declares, right with ``TRUST``;
* the address: the language that the path's first segment or a country suffix
  names, right with ``ADDRESS_TRUST``;
* the host: a prior from the other pages' declared languages, smoothed from all
  pages to the public suffix, the registered domain and the host.  The counts are
  grouped aggregates of (host, language), so a hot host is one row, and its
  pages are dealt over ``SALTS`` tasks when they get their prior.

Defined cases: a null or empty html has no text and no declaration; a null url
has the empty host and names nothing; without any evidence the languages'
overall shares decide; ties go to the first language in code order; languages
declared or named outside the candidates are no evidence; without any candidate
the language is null; repeated pages, and rows with equal or null ids, get one
row each; very long pages are read whole in one pass, and what is not closed in
their markup is read as text; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._spark import summed_table, table_rows
from .url_reputation import public_suffix, registered_domain, url_parts

CELLS, TABLE_BLOCKS = 1 << 15, 8
LEAST_SHARE = 0.005
EFFECTIVE, TRUST, ADDRESS_TRUST, WEIGHT, SALTS = 40, 0.9, 0.8, 5.0, 16

_ENTITY = re.compile(rb"&#?\w+;")
_RAW = re.compile(rb"<(script|style)\b", re.I)


def visible(html: bytes) -> bytes:
    """The text between tags, without scripts, styles and comments, in one pass.

    Each search goes on from where the last one ended, and one that finds
    nothing is not repeated, so hostile markup costs no more than its length.
    """
    low, out, at = html.lower(), [], 0
    ends = {b"-->": True, b"</script": True, b"</style": True}  # whether there may be one further on
    while (start := html.find(b"<", at)) >= 0:
        out.append(html[at:start])
        raw = _RAW.match(html, start)
        close = b"-->" if html.startswith(b"<!--", start) else b"</" + raw[1].lower() if raw else None
        end = -1
        if close and ends[close]:
            end = low.find(close, start + 4)
            ends[close] = end >= 0
        end = end + 2 if end >= 0 and close == b"-->" else html.find(b">", max(start, end))
        if end < 0:
            at = start
            break
        at = end + 1
    out.append(html[at:])
    return _ENTITY.sub(b" ", b" ".join(out))


def _cells(column: pa.Array):
    """For each chunk of pages: its first row, the words' cells and each page's first word."""
    buf, offs = t.ragged(column)
    for a, b in t.chunks(offs):
        texts = [t.LOWER[np.frombuffer(visible(buf[i:j].tobytes()), np.uint8)] for i, j in zip(offs[a:b].tolist(), offs[a + 1 : b + 1].tolist(), strict=True)]
        part, at = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        starts, ends, first = t.words(part, at, t.ALNUM)
        yield a, b, (t.word_hashes(part, starts, ends) >> t.U(49)).astype(np.int64), first


def declared_language(html: Column) -> Column:
    """The code that the first ``<html>`` tag declares, or the empty text; no pattern here goes back over what it read."""
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*+", 0)
    return F.lower(F.regexp_extract(tag, r"(?is)[\s:\"']lang\s*+=\s*+[\"']?+([a-z]{2,3})\b", 1))


def candidates(codes: DataFrame) -> tuple[str, ...]:
    """The codes of at least ``LEAST_SHARE`` of the rows ``code`` that have one, in code order."""
    count = codes.filter(F.col("code") != "").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = count.agg(F.sum("n").alias("all"))  # one row
    often = count.crossJoin(F.broadcast(total)).filter(F.col("n") >= LEAST_SHARE * F.col("all"))
    return tuple(sorted(r.code for r in often.select("code").collect()))  # at most 1 / LEAST_SHARE


def _one_of(found: Column, languages: tuple[str, ...]) -> Column:
    """The position of a language, or -1."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, languages)).cast("array<string>"), F.lower(found)).cast("int") - 1, F.lit(-1))


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-12))


def identify(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", languages: tuple[str, ...] | None = None) -> DataFrame:
    """Per page: ``page_id, language, confidence, declared, named, text_language, host``."""
    host, path = url_parts(F.col(url))
    declared = declared_language(F.col(html))
    languages = candidates(pages.select(declared.alias("code"))) if languages is None else languages
    size = max(1, len(languages))
    segment, suffix = F.regexp_extract(path, r"(?i)^/([a-z]{2})(?:/|$)", 1), F.substring_index(host, ".", -1)  # the country is the last label
    named = F.when(_one_of(segment, languages) >= 0, _one_of(segment, languages)).otherwise(_one_of(suffix, languages))
    rows = pages.select(F.col(page_id).alias("_id"), host.alias("host"), _one_of(declared, languages).alias("declared"), named.alias("named"), F.col(html).cast("binary").alias("_html"))
    # what the words and the hosts are learned from: declarations that the address does not contradict
    sure = F.when((F.col("named") < 0) | (F.col("named") == F.col("declared")), F.col("declared")).otherwise(-1)
    rows = rows.withColumn("sure", sure)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * CELLS)
        for batch in batches:
            label = batch.column("sure").to_numpy()
            for a, b, cell, first in _cells(batch.column("_html")):
                own = np.repeat(label[a:b], np.diff(first))
                table += np.bincount(own[own >= 0] * CELLS + cell[own >= 0], minlength=size * CELLS)
        if table.any():
            yield table_rows(table, TABLE_BLOCKS)

    table = summed_table(rows.select("sure", "_html").mapInArrow(gather, "block int, sums binary"), TABLE_BLOCKS)
    table = (table if len(table) else np.zeros(size * CELLS)).reshape(size, CELLS)
    # a language's words, smoothed towards all words; one without pages says nothing
    overall = (table.sum(0) + 0.5) / (table.sum() + 0.5 * CELLS)
    known = table.sum(1) > 0
    words = _log((table + 200.0 * overall) / (table.sum(1, keepdims=True) + 200.0))
    words[~known] = _log(overall)
    model = rows.sparkSession.sparkContext.broadcast(words.astype(np.float32))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, size))
            for a, b, cell, first in _cells(batch.column("_html")):
                n = np.diff(first)
                some = np.flatnonzero(n)
                if len(some):
                    total = np.add.reduceat(model.value[:, cell].astype(np.float64), first[:-1][some], axis=1).T
                    out[a + some] = total * np.minimum(1.0, EFFECTIVE / n[some])[:, None]
            out -= out.max(1, keepdims=True) if len(out) else 0
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("_id", "host", "declared", "named", "sure")} | {"text": pa.array(list(out), pa.list_(pa.float64()))})

    kind = rows.schema["_id"].dataType.simpleString()
    scored = rows.mapInArrow(likelihoods, f"_id {kind}, host string, declared int, named int, sure int, text array<double>")
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("_id", "text"), F.lit(SALTS)).cast("int"))
    priors = host_priors(rows.select("host", "sure"), size).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = salted.join(priors, ["host", "_salt"], "left")

    def said(column: str, trust: float):
        wrong = (1 - trust) / max(1, size - 1)
        return lambda i: F.when(F.col(column) < 0, 0.0).when(F.col(column) == i, float(np.log(trust))).otherwise(float(np.log(wrong)))

    # the host's prior without the page's own declaration
    own = lambda i: (F.col("sure") == i).cast("double")
    prior = lambda i: F.log((F.col("counts")[i] - own(i) + WEIGHT * F.col("parent")[i]) / (F.col("n") - (F.col("sure") >= 0).cast("double") + WEIGHT))
    log_post = F.array(*(F.col("text")[i] + said("declared", TRUST)(i) + said("named", ADDRESS_TRUST)(i) + prior(i) for i in range(size)))
    out = joined.withColumn("post", log_post).withColumn("top", F.array_max("post"))
    names = F.array(*map(F.lit, languages)).cast("array<string>")
    total = F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    pick = lambda c: F.get(names, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return out.select(
        F.col("_id").alias(page_id), pick(F.col("post")).alias("language"), (1 / total).alias("confidence"),
        F.when(F.col("declared") >= 0, F.get(names, F.col("declared"))).alias("declared"), F.when(F.col("named") >= 0, F.get(names, F.col("named"))).alias("named"),
        F.when(F.array_min("text") < 0, pick(F.col("text"))).alias("text_language"), "host",
    )


def host_priors(rows: DataFrame, size: int) -> DataFrame:
    """Per host: surely declared pages ``n``, their ``counts`` per language and the ``parent`` prior of its domain."""
    one = [F.sum((F.col("sure") == i).cast("double")) for i in range(size)]
    hosts = rows.groupBy("host").agg(*(c.alias(f"c{i}") for i, c in enumerate(one)))
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))

    def add(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(size)))

    domains = add(hosts, "domain", "suffix")
    suffixes = add(domains, "suffix")
    n = sum((F.col(f"c{i}") for i in range(1, size)), F.col("c0"))

    def smoothed(parent) -> list[Column]:
        return [((F.col(f"c{i}") + WEIGHT * parent(i)) / (n + WEIGHT)) for i in range(size)]

    root = add(suffixes).select(F.array(*(((F.coalesce(F.col(f"c{i}"), F.lit(0.0)) + 1.0) / (F.coalesce(n, F.lit(0.0)) + size)) for i in range(size))).alias("root"))  # one row
    s = suffixes.crossJoin(F.broadcast(root)).select("suffix", F.array(*smoothed(lambda i: F.col("root")[i])).alias("up"))
    d = domains.join(s, "suffix").select("domain", F.array(*smoothed(lambda i: F.col("up")[i])).alias("parent"))
    return hosts.join(d, "domain").select("host", n.alias("n"), F.array(*(F.col(f"c{i}") for i in range(size))).alias("counts"), "parent")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"))
