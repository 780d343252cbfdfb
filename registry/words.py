"""Tokens, word vectors, word hashes and hash tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import draws
from clickloom.functions import hashing as H
from clickloom.functions import text as X
from clickloom.functions.vectors import pad_vector
from clickloom.operators import embeddings as E
from clickloom.operators import hashtable, stats
from clickloom.operators import sentences as N
from clickloom.operators.numbering import number_rows
from clickloom.plans.jobs import text_to_vector_batches
from clickloom.session import new_path, spread, store, store_counted
from clickloom.sinks.files import write_padded_vectors
from clickloom.sources.text import read_word_vectors
from clickloom.sources.vector_store import write_vector_store
from registry.base import query, table

DIM = 64
PADDING = 16


# --- SQL for tokens ---------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens_sql(text: str) -> str:
    spaced = f"' ' || {text} || ' '"
    for pattern, replacement in X.TOKEN_RULES:
        spaced = f"regexp_replace({spaced}, {q(pattern)}, {q(replacement)}, 'g')"
    return f"list_filter(string_split_regex({spaced}, '\\s+'), lambda t: t <> '')"


def alpha_sql(text: str) -> str:
    return (
        f"list_filter({tokens_sql(f'translate({text}, {q(X.MARKUP)}, {q(chr(32) * 0)})')}, "
        f"lambda t: regexp_matches(t, {q(X.LETTERS)}))"
    )


TOKENS = (
    "tok AS (SELECT doc_id, cast(generate_subscripts(ts, 1) - 1 as bigint) AS pos, "
    f"unnest(ts) AS token FROM (SELECT doc_id, {alpha_sql('text')} AS ts FROM documents))"
)
WORDS = (
    TOKENS + ", ranked AS (SELECT token AS word, row_number() over (order by count(*) desc, token) "
    "- 1 AS idx, count(*) AS cnt FROM tok GROUP BY token), vecs AS (SELECT embedding AS vec, "
    "row_number() over (order by vec_id) - 1 AS idx FROM embeddings), words AS "
    "(SELECT word, idx, vec FROM ranked JOIN vecs USING (idx))"
)
SUM = "cast(list_sum(list_transform(vec, lambda v: cast(floor(cast(v as double) * 1000000) as bigint))) as bigint)"
ENDS = (
    f"cast(floor(cast(vec[1] as double) * 1000000) as bigint) AS v_first, "
    f"cast(floor(cast(vec[{DIM}] as double) * 1000000) as bigint) AS v_last, {SUM} AS v_sum"
)


def micro(c):
    return F.floor(c.cast("double") * 1000000).cast("bigint")


def total(vec):
    """Sum of a vector's components in whole millionths: compiled for ``DIM`` of them, else a loop."""
    each = reduce(Column.__add__, [micro(F.get(vec, F.lit(i))) for i in range(DIM)])
    loop = F.aggregate(vec, F.lit(0).cast("bigint"), lambda a, v: a + micro(v))
    return F.when(F.size(vec) == DIM, each).otherwise(loop)


def vector_columns():
    """First, last and sum of a vector's components, in whole millionths."""
    return [
        micro(F.get("vec", F.lit(0))).alias("v_first"),
        micro(F.get("vec", F.lit(DIM - 1))).alias("v_last"),
        total(F.col("vec")).alias("v_sum"),
    ]


def word_table(spark, sf, tokens: DataFrame | None = None) -> DataFrame:
    """Tokens by frequency; as many get a vector as there are embeddings."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    placed = number_rows(vectors, [F.col("vec_id")], name="idx", rows=vectors.count())
    return store(
        all_words(spark, sf, tokens).join(placed, "idx").select(
            "word", "idx", F.col("embedding").alias("vec")
        ),
        "words",
    )


def docs(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def joined(c):
    return F.array_join(c, " ")


# --- text functions ---------------------------------------------------------


@query("strip_markup", "SELECT page_id, translate(html, '@<>', '') AS plain FROM pages")
def strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_markup(F.col("html")).alias("plain"))


@query("tokenize", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, sf):
    return docs(spark, sf).select("doc_id", joined(X.tokenize(F.col("text"))).alias("tokens"))


@query(
    "lowercase_tokens",
    f"SELECT doc_id, array_to_string({tokens_sql('lower(text)')}, ' ') AS tokens FROM documents",
)
def lowercase_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", joined(X.lowercase_tokens(F.col("text"))).alias("tokens"))


@query(
    "keep_alpha_tokens",
    f"SELECT conv_id, turn, array_to_string(list_filter({tokens_sql('text')}, "
    f"lambda t: regexp_matches(t, {q(X.LETTERS)})), ' ') AS tokens FROM conversations",
)
def keep_alpha_tokens(spark, sf):
    turns = table(spark, sf, "conversations")
    tokens = X.keep_alpha(X.tokenize(F.col("text")))
    return turns.select("conv_id", "turn", joined(tokens).alias("tokens"))


@query(
    "preprocess_text",
    f"SELECT doc_id, array_to_string({alpha_sql('text')}, ' ') AS tokens FROM documents",
)
def preprocess_text(spark, sf):
    return docs(spark, sf).select("doc_id", joined(X.preprocess_text(F.col("text"))).alias("tokens"))


K = 4


def _chunk(i: int) -> str:
    size = f"(length(text) // {K})"
    start = f"cast({size} * {i} + 1 as integer)"
    return f"substr(text, {start})" if i == K - 1 else f"substr(text, {start}, cast({size} as integer))"


@query(
    "chunk_text",
    " UNION ALL ".join(f"SELECT doc_id, {i} AS chunk, {_chunk(i)} AS part FROM documents" for i in range(K)),
)
def chunk_text(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.posexplode(X.chunk_text(F.col("text"), K)).alias("chunk", "part")
    )


@query(
    "flatten_tokens",
    "SELECT doc_id, array_to_string(list_concat("
    + "list_concat(" * (K - 2) + alpha_sql(_chunk(0)) + ", "
    + "), ".join(alpha_sql(_chunk(i)) for i in range(1, K))
    + "), ' ') AS tokens FROM documents",
)
def flatten_tokens(spark, sf):
    chunks = X.tokens_by_chunk(F.col("text"), K)
    return docs(spark, sf).select("doc_id", joined(X.flatten_tokens(chunks)).alias("tokens"))


@query(
    "doc_token_stats",
    f"SELECT doc_id, cast(strlen(text) as bigint) AS n_bytes, cast(len({alpha_sql('text')}) as bigint) "
    f"AS n_tokens, {DIM} AS dim FROM documents",
)
def doc_token_stats(spark, sf):
    return E.doc_token_stats(docs(spark, sf), DIM)


# --- sentences ---------------------------------------------------------------

PERIODS = (
    "bare AS (SELECT regexp_replace(regexp_replace(w, "
    f"{q(N.BEFORE)}, ''), {q(N.BEHIND)}, '') AS w FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents)), "
    "stems AS (SELECT lower(case when ends_with(w, '.') then left(w, length(w) - 1) else w end) AS word, "
    f"ends_with(w, '.') AS ended FROM bare), counts AS MATERIALIZED (SELECT word, count(*) AS n, count(*) FILTER (ended) AS k "
    f"FROM stems WHERE regexp_matches(word, {q(N.WORD)}) GROUP BY word), "
    "scores AS (SELECT word, n, k, round(2.0::double * (k * ln(0.99::double) + (n - k) * ln(1 - 0.99::double) - k * ln(p) "
    "- case when n > k then (n - k) * ln(1 - p) else 0 end) * exp(-m) * (length(word) - m + 1) * pow(m::double, -(n - k)), 6) AS score "
    "FROM (SELECT *, length(replace(word, '.', '')) AS m, sum(k) over () / sum(n) over () AS p FROM counts) WHERE k > 0)"
)


@query("abbreviation_scores", f"WITH {PERIODS} SELECT word, n, k, score >= 0.3 AS abbreviation FROM scores")
def abbreviation_scores(spark, sf):
    """Words by how surely their period is part of them."""
    scores = N.abbreviation_scores(N.period_counts(docs(spark, sf)))
    return scores.select("word", "n", "k", (F.col("score") >= N.LEAST_SCORE).alias("abbreviation"))


_FORMS = (
    "SELECT '(^|[\\s\"''“‘(\\[])(' || string_agg(replace(f, '.', '\\.'), '|') || ')\\.(\\s)' AS pattern FROM "
    "(SELECT DISTINCT unnest([word, upper(left(word, 1)) || substr(word, 2), upper(word)]) AS f FROM scores WHERE score >= 0.3)"
)


def _held(text: str) -> str:
    return f"case when pattern is null then {text} else regexp_replace({text}, pattern, '\\1\\2{N.HELD}\\3', 'g') end"


@query(
    "tokenize_sentences",
    f"WITH {PERIODS}, forms AS ({_FORMS}), once AS (SELECT doc_id, pattern, {_held('text')} AS text FROM documents, forms), "
    f"held AS (SELECT doc_id, {_held('text')} AS text FROM once) SELECT doc_id, "
    f"translate(array_to_string({tokens_sql('text')}, ' '), '{N.HELD}', '.') AS tokens FROM held",
)
def tokenize_sentences(spark, sf):
    """Tokens with the abbreviations that the texts themselves teach."""
    texts = docs(spark, sf)
    known = N.learn_abbreviations(texts)
    return texts.select("doc_id", joined(N.tokenize(F.col("text"), known)).alias("tokens"))


# --- word vectors -----------------------------------------------------------


@query("scan_word_vectors", f"WITH {WORDS} SELECT word, idx, cast(len(vec) as integer) AS dim, {ENDS} FROM words")
def scan_word_vectors(spark, sf):
    path = new_path(spark, "word-vectors")
    word_table(spark, sf).write.parquet(path)
    return read_word_vectors(spark, path).select(
        "word", "idx", F.size("vec").alias("dim"), *vector_columns()
    )


@query(
    "embedding_lookup",
    f"WITH {WORDS} SELECT doc_id, pos, token, idx, {ENDS} FROM tok LEFT JOIN words ON token = word",
)
def embedding_lookup(spark, sf):
    tokens = E.tokenized(docs(spark, sf))
    found = E.lookup_words(tokens, word_table(spark, sf, tokens))
    return found.select("doc_id", "pos", "token", "idx", *vector_columns())


@query(
    "embedding_lookup_large",
    f"WITH {WORDS} SELECT doc_id, pos, token, idx, {ENDS} FROM tok LEFT JOIN words ON token = word",
)
def embedding_lookup_large(spark, sf):
    """The way for word tables too large to broadcast: mapped files."""
    tokens = E.tokenized(docs(spark, sf))
    vectors = write_vector_store(word_table(spark, sf, tokens), DIM)
    found = E.lookup_in_store(tokens, vectors)
    return found.select("doc_id", "pos", "token", "idx", *vector_columns())


@query(
    "embedding_lookup_shuffled",
    f"WITH {WORDS} SELECT doc_id, pos, token, idx, {ENDS} FROM tok LEFT JOIN words ON token = word",
)
def embedding_lookup_shuffled(spark, sf):
    """The way for large word tables whose vectors differ in length."""
    tokens = E.tokenized(docs(spark, sf))
    found = E.lookup_shuffled(tokens, word_table(spark, sf, tokens))
    return found.select("doc_id", "pos", "token", "idx", *vector_columns())


@query(
    "split_in_out_vocab",
    f"WITH {WORDS} SELECT doc_id, count(word) AS in_vocab, count(*) - count(word) AS out_vocab "
    "FROM tok LEFT JOIN words ON token = word GROUP BY doc_id",
)
def split_in_out_vocab(spark, sf):
    tokens = E.tokenized(docs(spark, sf))
    known, unknown = E.split_known(E.token_rows(tokens), word_table(spark, sf, tokens))
    sides = known.select("doc_id", F.lit(1).alias("k")).unionByName(
        unknown.select("doc_id", F.lit(0).alias("k"))
    )
    return sides.groupBy("doc_id").agg(
        F.count_if(F.col("k") == 1).alias("in_vocab"), F.count_if(F.col("k") == 0).alias("out_vocab")
    )


def _gauss() -> str:
    """Gaussian components from the two starts, one for each step of the sequences."""
    (m1, _), (m2, _) = draws.GENERATORS
    names = ("a1", "a2", "b1", "b2")
    steps = ", ".join(
        "{" + ", ".join(f"'{n}': {x}" for n, x in zip(names, step)) + "}"
        for step in draws.generator_steps(DIM)
    )

    def uniform(k: str) -> str:
        z = f"((s1 * t.{k}1 % {m1} - s2 * t.{k}2 % {m2}) % {m1 - 1} + {m1 - 1}) % {m1 - 1}"
        return f"(cast(coalesce(nullif({z}, 0), {m1 - 1}) as double) / {float(m1)!r}::double)"

    return (
        f"list_transform([{steps}], lambda t: cast(sqrt(-2.0::double * ln({uniform('a')})) "
        f"* cos(2.0::double * pi() * {uniform('b')}) as float))"
    )


def _start(at: int, modulus: int) -> str:
    digest = "md5(concat_ws('|', '17', cast(doc_id as varchar), cast(pos as varchar)))"
    return f"('0x' || substr({digest}, {at}, 15))::bigint % {modulus - 1} + 1"


FILLED = (
    f"SELECT doc_id, pos, token, idx, coalesce(vec, {_gauss()}) AS vec FROM "
    f"(SELECT *, {_start(1, draws.GENERATORS[0][0])} AS s1, {_start(17, draws.GENERATORS[1][0])} AS s2 "
    "FROM tok LEFT JOIN words ON token = word)"
)


@query(
    "embedding_oov_random",
    f"WITH {WORDS}, filled AS ({FILLED}) SELECT doc_id, pos, token, {ENDS} FROM filled WHERE idx IS NULL",
)
def embedding_oov_random(spark, sf):
    tokens = E.tokenized(docs(spark, sf))
    found = E.lookup_words(tokens, word_table(spark, sf, tokens))
    filled = E.fill_unknown(found.where(F.col("idx").isNull()), DIM, seed=17)
    return filled.select("doc_id", "pos", "token", *vector_columns())


@query(
    "embedding_batch_order",
    f"WITH {WORDS}, t AS (SELECT doc_id, pos, token, pos // 512 AS batch, "
    "case when idx is null then 1 else 0 end AS is_oov FROM tok LEFT JOIN words ON token = word) "
    "SELECT doc_id, pos, token, is_oov, batch * 512 + row_number() over "
    "(partition by doc_id, batch order by is_oov, pos) - 1 AS out_pos FROM t",
)
def embedding_batch_order(spark, sf):
    tokens = E.tokenized(docs(spark, sf))
    found = E.lookup_words(tokens, word_table(spark, sf, tokens))
    return E.batch_order(found).select("doc_id", "pos", "token", "is_oov", "out_pos")


@query(
    "text_to_vectors",
    f"WITH {WORDS}, filled AS ({FILLED}) SELECT doc_id, pos // 512 AS batch, count(*) AS n, "
    f"cast(sum((pos + 1) * {SUM} % 1000003) as bigint) AS checksum FROM filled GROUP BY ALL",
)
def text_to_vectors_(spark, sf):
    tokens = E.tokenized(docs(spark, sf))
    batches = text_to_vector_batches(tokens, word_table(spark, sf, tokens), DIM, seed=17)
    # Rows of single vectors, which stay in their task until they are summed.
    each = batches.select("doc_id", "batch", F.posexplode("vecs").alias("i", "vec"))
    weighted = (F.col("batch") * 512 + F.col("i") + 1) * total(F.col("vec")) % 1000003
    return each.groupBy("doc_id", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.sum(weighted).alias("checksum")
    )


@query(
    "pad_vector",
    f"SELECT vec_id, cast(len(vec) as integer) AS dim, {SUM} AS v_sum, cast(vec[{DIM + PADDING}] as double) AS tail "
    f"FROM (SELECT vec_id, list_concat(embedding, list_transform(range({PADDING}), lambda i: 0::float)) AS vec FROM embeddings)",
)
def pad_vector_(spark, sf):
    padded = table(spark, sf, "embeddings").select(
        "vec_id", pad_vector(F.col("embedding"), PADDING).alias("vec")
    )
    return padded.select(
        "vec_id",
        F.size("vec").alias("dim"),
        vector_columns()[2],
        F.element_at("vec", -1).cast("double").alias("tail"),
    )


@query(
    "write_padded_vectors",
    f"WITH {WORDS} SELECT word, idx, {DIM + PADDING} AS dim, {SUM} AS v_sum FROM words",
)
def write_padded_vectors_(spark, sf):
    path = new_path(spark, "padded")
    write_padded_vectors(word_table(spark, sf), path, PADDING)
    return spark.read.parquet(path).select("word", "idx", F.size("vec").alias("dim"), vector_columns()[2])


# --- all distinct tokens, by frequency --------------------------------------

ALL_WORDS = (
    TOKENS + ", words AS (SELECT token AS word, row_number() over (order by count(*) desc, token) "
    "- 1 AS idx FROM tok GROUP BY token)"
)


def all_words(spark, sf, tokens: DataFrame | None = None) -> DataFrame:
    """All words by frequency, of the documents or of tokens made before."""
    tokens = docs(spark, sf) if tokens is None else tokens
    counted = E.token_rows(tokens).groupBy(F.col("token").alias("word")).count()
    counts, rows = store_counted(counted, "word-counts")
    order = [F.col("count").desc(), F.col("word")]
    return store(number_rows(counts, order, name="idx", rows=rows).drop("count"), "all-words")


@query(
    "vocab_length_stats",
    f"WITH {WORDS} SELECT count(*) AS words, cast(max(len(vec)) as integer) AS vector_size, "
    "cast(max(length(word)) as integer) AS max_length, cast(sum(greatest(length(word), 25)) as bigint) "
    "AS total_length, avg(greatest(length(word), 25)) AS average_length FROM words",
)
def vocab_length_stats(spark, sf):
    return stats.vocabulary_lengths(word_table(spark, sf))


@query(
    "running_max_word",
    f"WITH {ALL_WORDS} SELECT cast(length(word) as integer) AS length, idx, word FROM (SELECT *, "
    "max(length(word)) over (order by idx rows between unbounded preceding and 1 preceding) AS before "
    "FROM words) WHERE length(word) > coalesce(before, 0)",
)
def running_max_word(spark, sf):
    return stats.running_max_words(all_words(spark, sf))


# --- hashes -----------------------------------------------------------------

P64 = "18446744073709551616::hugeint"


def signed(h: str) -> str:
    return f"cast(case when {h} >= 9223372036854775808::hugeint then {h} - {P64} else {h} end as bigint)"


def bytes_sql(word: str) -> str:
    digits = f"hex(encode({word}))"
    return (
        f"list_transform(range(cast(strlen({word}) as bigint)), lambda i: "
        f"cast(('0x' || substr({digits}, cast(2 * i + 1 as integer), 2))::bigint as hugeint))"
    )


def xor_hash_sql(word: str) -> str:
    x = "xor(h, b)"
    step = f"({x} * 32) % {P64} + {x} // 576460752303423488::hugeint"
    return f"list_reduce({bytes_sql(word)}, lambda h, b: {step}, {H.XOR_SEED}::hugeint)"


def fnv_sql(word: str, multiplier: int) -> str:
    step = f"(xor(h, b) * {multiplier}) % {P64}"
    return f"list_reduce({bytes_sql(word)}, lambda h, b: {step}, {H.FNV_START}::hugeint)"


def hashed(fn: str) -> str:
    return f"{ALL_WORDS}, hashed AS MATERIALIZED (SELECT word, idx, {fn} AS h FROM words)"


def low(bits: int) -> str:
    return f"cast(h % {2**bits} as bigint)"


def upper(bits: int) -> str:
    return f"cast(h // {2**bits} as bigint)"


XOR = xor_hash_sql("word")


@query(
    "utf8_bytes",
    f"WITH {ALL_WORDS} SELECT word, array_to_string({bytes_sql('word')}, ',') AS bytes FROM words",
)
def utf8_bytes(spark, sf):
    return all_words(spark, sf).select(
        "word", F.array_join(H.utf8_bytes(F.col("word")), ",").alias("bytes")
    )


@query(
    "xor_rotate_hash",
    f"WITH {hashed(XOR)} SELECT word, {signed('h')} AS hash, cast(h as varchar) AS printed FROM hashed",
)
def xor_rotate_hash(spark, sf):
    h = H.xor_rotate_hash(F.col("word"))
    hashed_words = all_words(spark, sf).select("word", h.alias("hash"))
    return hashed_words.withColumn("printed", H.unsigned(F.col("hash")))


@query(
    "fnv1a_hash",
    f"WITH {ALL_WORDS}, h AS (SELECT word, {fnv_sql('word', 513)} AS a, {fnv_sql('word', 315)} AS b "
    f"FROM words) SELECT word, {signed('a')} AS hash_513, {signed('b')} AS hash_315 FROM h",
)
def fnv1a_hash(spark, sf):
    word = F.col("word")
    return all_words(spark, sf).select(
        "word",
        H.fnv1a_hash(word).alias("hash_513"),
        H.fnv1a_hash(word, H.FNV_MULTIPLIERS[1]).alias("hash_315"),
    )


@query(
    "hash_bits",
    f"WITH {hashed(XOR)} SELECT word, {low(22)} AS low22, {upper(22)} AS upper42, {low(24)} AS low24, "
    f"{upper(24)} AS upper40 FROM hashed",
)
def hash_bits(spark, sf):
    h = F.col("h")
    return (
        all_words(spark, sf)
        .withColumn("h", H.xor_rotate_hash(F.col("word")))
        .select(
            "word",
            H.low_bits(h, 22).alias("low22"),
            H.upper_bits(h, 22).alias("upper42"),
            H.low_bits(h, 24).alias("low24"),
            H.upper_bits(h, 24).alias("upper40"),
        )
    )


ENTRY = f"((h // 16777216) * 16777216 + idx % 16777216)"


@query("pack_entry", f"WITH {hashed(XOR)} SELECT word, idx, {signed(ENTRY)} AS entry FROM hashed")
def pack_entry(spark, sf):
    h = H.xor_rotate_hash(F.col("word"))
    return all_words(spark, sf).select("word", "idx", H.pack_entry(h, F.col("idx")).alias("entry"))


SMALL_BITS = 10  # few buckets, so that they collide on small vocabularies


def fnv(word):
    return H.fnv1a_hash(word)


FNV = fnv_sql("word", 513)
HISTOGRAM = f"{hashed(FNV)}, hist AS (SELECT {low(SMALL_BITS)} AS h, count(*) AS n FROM hashed GROUP BY 1)"


@query("hash_collision_histogram", f"WITH {HISTOGRAM} SELECT h, n FROM hist")
def hash_collision_histogram(spark, sf):
    return hashtable.collision_histogram(all_words(spark, sf), fnv, SMALL_BITS)


@query("hash_max_collisions", f"WITH {HISTOGRAM} SELECT h, n FROM hist WHERE n = (SELECT max(n) FROM hist)")
def hash_max_collisions(spark, sf):
    return hashtable.most_collided(hashtable.collision_histogram(all_words(spark, sf), fnv, SMALL_BITS))


SLOTS = (
    f"{hashed(XOR)}, slots AS (SELECT word, h, {low(SMALL_BITS)} AS bucket, idx, "
    f"{signed(ENTRY)} AS entry, row_number() over (partition by {low(SMALL_BITS)} order by idx) "
    "- 1 AS slot FROM hashed)"
)


def entries(spark, sf, bits=SMALL_BITS) -> DataFrame:
    return hashtable.entries(all_words(spark, sf), H.xor_rotate_hash, bits=bits)


@query("bucket_slot", f"WITH {SLOTS} SELECT bucket, idx, entry, slot FROM slots WHERE slot < 20")
def bucket_slot(spark, sf):
    return hashtable.bucket_slots(entries(spark, sf), cap=20)


@query(
    "build_hash_table",
    f"WITH {SLOTS} SELECT bucket, slot // 1024 AS chunk, string_agg(cast(entry as varchar), ',' "
    "order by slot) AS entries FROM slots GROUP BY ALL",
)
def build_hash_table(spark, sf):
    built = hashtable.build_hash_table(entries(spark, sf))
    return built.withColumn("entries", F.array_join("entries", ","))


@query(
    "hash_table_probe",
    f"WITH {hashed(XOR)}, keyed AS MATERIALIZED (SELECT word, idx, cast(h % {2**63} as bigint) AS low, "
    f"cast(h // {2**63} as bigint) AS high, cast(h % 16777216 as bigint) AS bucket FROM hashed) "
    "SELECT p.word, p.bucket, cast(t.idx % 16777216 as bigint) AS found_idx "
    "FROM keyed p LEFT JOIN keyed t ON p.low = t.low AND p.high = t.high",
)
def hash_table_probe(spark, sf):
    """What a hash table is for is one join on the hash here."""
    h = H.xor_rotate_hash(F.col("word"))
    hashed = store(all_words(spark, sf).withColumn("h", h), "hashed-words")
    known = hashed.select("h", F.col("idx").alias("found_idx"))
    bucket = H.low_bits(F.col("h"), 24).alias("bucket")
    return hashed.join(known, "h", "left").select("word", bucket, "found_idx")
