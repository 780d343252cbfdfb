"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

A probe of the filter touches one block of 512 bits. What passes is possibly listed; an exact hash
join with the list removes the false positives, so the filter only saves work. The list holds the URLs
of pages that publish given texts; what a URL says about itself does not count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import lower_ascii, mixed

WORDS = 8  # of 64 bits in a block
PROBES = 6  # bits of one URL
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 17  # 8 MB: what is broadcast never grows beyond it


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and ``m.``, and path without its last ``/``, ``.html`` or index page.

    Scheme, query and fragment do not count. A URL without ``://`` has an empty canonical form.
    """
    host = F.regexp_replace(host_of(url), r"^(www\.|m\.)+|:[0-9]*$|\.+$", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    return F.concat(host, path)


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits a host or subdomain and a path prefix."""
    ranked = sorted(rules, key=lambda r: -len(r.host + r.path))
    if not ranked:
        return F.lit(None).cast("struct<verdict:string,rule:string>")

    def fits(r: Rule) -> Column:
        named = (host == r.host) | host.endswith(f".{r.host}")
        return named & path.startswith(r.path)

    def made(r: Rule) -> Column:
        return F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.host + r.path).alias("rule"))

    first = F.when(fits(ranked[0]), made(ranked[0]))
    return reduce(lambda c, r: c.when(fits(r), made(r)), ranked[1:], first)


def positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its ``PROBES`` bit positions in the block."""
    block = (hashes % np.uint64(blocks)).astype(np.int64)
    spread = mixed(hashes)
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(9)
    return block, ((spread[:, None] >> shifts) & np.uint64(511)).astype(np.int64)


def bloom(listed: DataFrame, urls: int) -> np.ndarray:
    """The filter over column ``key`` (BIGINT hashes) of ``listed``: one row of words per block.

    Bits are gathered per block in the tasks and united by ``bit_or``; the driver receives at most
    ``MAX_BLOCKS`` blocks of 64 bytes. A longer list only makes more false positives.
    """
    wanted = max(1, urls * BITS_PER_URL // 512)
    blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    names = [f"w{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block, bits = positions(keys, blocks)
            own, at = np.unique(block, return_inverse=True)
            words = np.zeros((len(own), WORDS), np.uint64)
            for column in bits.T:
                np.bitwise_or.at(words, (at, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
            yield pa.record_batch(
                [pa.array(own), *[pa.array(w.copy().view(np.int64)) for w in words.T]],
                ["block", *names],
            )

    schema = "block long, " + ", ".join(f"{n} long" for n in names)
    united = listed.select("key").mapInArrow(run, schema).groupBy("block").agg(
        *[F.bit_or(n).alias(n) for n in names]
    )
    table = np.zeros((blocks, WORDS), np.uint64)
    for row in united.toLocalIterator():
        table[row[0]] = np.array(row[1:], np.int64).view(np.uint64)
    return table


def maybe_listed(table: np.ndarray):
    """Pandas UDF: whether a hash passes the filter."""

    @F.pandas_udf("boolean")
    def passes(keys):
        import pandas as pd

        block, bits = positions(keys.to_numpy(np.int64).view(np.uint64), len(table))
        words = table[block[:, None], bits >> 6]
        hit = (words >> (bits & 63).astype(np.uint64)) & np.uint64(1)
        return pd.Series(hit.all(axis=1))

    return passes


def judged(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, listed_rows: int, verdict="block"
) -> DataFrame:
    """``pages`` as one struct column ``row`` with ``host``, ``path``, ``rule``, ``verdict``.

    ``listed`` has distinct canonical URLs in ``canonical``, none empty. Null URLs and URLs without
    ``://`` have empty host and path, no rule, and are allowed. URLs of any length are read whole. Rows that a rule decides skip the
    filter. Repeated rows are judged each; a URL that holds a third of all rows is a skewed key of
    a plain left join to a table of distinct keys, which Spark splits.
    """
    table = bloom(listed.select(F.xxhash64("canonical").alias("key")), listed_rows)
    passes = maybe_listed(table)
    url = F.col("url")
    known = pages.select(
        F.struct("*").alias("row"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        canonical(url).alias("canonical"),
    )
    found = first_rule(F.col("host"), F.col("path"), rules)
    known = known.withColumn("found", found)
    known = known.withColumn(
        "probe",
        F.when(
            F.col("found").isNull() & (F.col("canonical") != "") & passes(F.xxhash64("canonical")),
            F.col("canonical"),
        ),
    )
    exact = listed.select(F.col("canonical").alias("probe"), F.lit(True).alias("hit"))
    hits = known.where("probe is not null").join(exact, "probe", "left")
    clear = known.where("probe is null").withColumn("hit", F.lit(None).cast("boolean"))
    both = hits.select(*clear.columns).unionByName(clear)
    own = F.when(F.col("hit"), F.lit(verdict)).otherwise(F.lit("allow"))
    return both.select(
        "row", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", own).alias("verdict"), F.col("hit").isNotNull().alias("listed"),
    )


def plain_text(text: Column) -> Column:
    """``text`` with every run of white space as one space, and none around it; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def article(html: Column) -> Column:
    """What the ``article`` of a page says after its heading, without tags, as ``plain_text``."""
    own = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?s)<article>(.*?)</article>", 1)
    own = F.regexp_replace(F.regexp_replace(own, r"(?s)<h1>.*?</h1>", " "), r"<[^>]*>", " ")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        own = F.replace(own, F.lit(entity), F.lit(character))
    return plain_text(own)


SALTS = 32


def text_digest(plain: Column) -> Column:
    """SHA-256 of what ``plain_text`` or ``article`` returns; null if that is empty."""
    return F.when(plain != "", F.sha2(plain, 256))


def listed_urls(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct canonical URLs (``canonical``) of ``pages`` whose article is one of ``texts``.

    ``texts`` has the ``digest`` (``text_digest``) of each. The list comes from what is published, so a
    page that is judged by it may have another article, or none. Null, empty and repeated texts, null
    ``html`` and URLs without ``://`` list nothing. A text that very many pages publish is met in
    ``SALTS`` parts.
    """
    wanted = texts.where("digest is not null").select("digest").distinct()
    wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    published = pages.select(
        canonical(F.col("url")).alias("canonical"), text_digest(article(F.col("html"))).alias("digest")
    )
    published = published.where("canonical <> '' and digest is not null").distinct()
    published = published.withColumn("salt", F.pmod(F.xxhash64("canonical"), F.lit(SALTS)).cast("int"))
    return published.join(wanted, ["digest", "salt"], "left_semi").select("canonical").distinct()
