"""Tokens, hashes, vectors and hash tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from clickloom.functions import draws
from clickloom.functions import hashing as H
from clickloom.functions import text as X
from clickloom.functions.vectors import pad_vector
from clickloom.operators import embeddings as E
from clickloom.operators import hashtable

MASK = 2**64 - 1


def value(spark, expression, text):
    df = spark.createDataFrame([(text,)], "c string")
    return df.select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("Hello, world.", ["Hello", ",", "world", "."]),
        ("I don't know; it's 3,000.5!", ["I", "do", "n't", "know", ";", "it", "'s", "3,000.5", "!"]),
        ("One. Two (three).", ["One", ".", "Two", "(", "three", ")", "."]),
        ("etc. and so on...", ["etc.", "and", "so", "on", "...",]),
        ("They'll say \"no\" -- we've heard", ["They", "'ll", "say", '"', "no", '"', "--", "we", "'ve", "heard"]),
        ("'quoted' word", ["'", "quoted", "'", "word"]),
        ("A. B. C. Then", ["A", ".", "B", ".", "C", ".", "Then"]),
        ("Wait... What", ["Wait", "...", "What"]),
        ("The end. ... Then", ["The", "end", ".", "...", "Then"]),
        ("'No.' (Yes.)", ["'", "No", ".", "'", "(", "Yes", ".", ")"]),
        ("", []),
        ("  \n ", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert value(spark, X.tokenize, text) == tokens


def test_preprocess_text(spark):
    found = value(spark, X.preprocess_text, "@@12 <p> The café isn't n1ce. Straße, go!")
    assert found == ["p", "The", "café", "is", "Straße", "go"]


@pytest.mark.parametrize("text", ["", "ab", "abcdefghij", "naïve text"])
def test_chunks_cover_the_text(spark, text):
    chunks = value(spark, lambda c: X.chunk_text(c, 4), text)
    assert "".join(chunks) == text and len(chunks) == 4
    assert [len(c) for c in chunks[:3]] == [len(text) // 4] * 3


def python_xor(word):
    h = H.XOR_SEED
    for byte in word.encode():
        x = h ^ byte
        h = ((x << 5) | (x >> 59)) & MASK
    return h


def python_fnv(word, low):
    h = (0x6C62272E07BB0142 << 64) | H.FNV_START
    for byte in word.encode():
        h = ((h ^ byte) * ((1 << 88) + low)) % 2**128
    return h & MASK


WORDS = ["", "I", "the", "naïve", "日本語", "a" * 300]


def test_hashes(spark):
    assert value(spark, H.xor_rotate_hash, "I") == -8339287993036562067
    for word in WORDS:
        assert value(spark, H.xor_rotate_hash, word) & MASK == python_xor(word)
        for low in H.FNV_MULTIPLIERS:
            assert value(spark, lambda c: H.fnv1a_hash(c, low), word) & MASK == python_fnv(word, low)
        assert value(spark, H.utf8_bytes, word) == list(word.encode())
        assert value(spark, lambda c: H.unsigned(H.xor_rotate_hash(c)), word) == str(python_xor(word))


def test_bits_and_entries(spark):
    for word in WORDS:
        h = python_xor(word)
        assert value(spark, lambda c: H.low_bits(H.xor_rotate_hash(c), 22), word) == h & 0x3FFFFF
        assert value(spark, lambda c: H.upper_bits(H.xor_rotate_hash(c), 22), word) == h >> 22
        entry = value(spark, lambda c: H.pack_entry(H.xor_rotate_hash(c), F.lit(5).cast("bigint")), word)
        assert entry & MASK == (h >> 24 << 24) | 5


def test_hash_table(spark, monkeypatch):
    """One bucket for a third of the words; rows of a bucket hold few entries."""
    monkeypatch.setattr(hashtable, "CHUNK", 16)
    words = [f"w{i}" for i in range(250)]
    df = spark.createDataFrame(list(enumerate(words)), "idx bigint, word string")

    def crowded(c):
        h = F.xxhash64(c)
        return F.when(F.pmod(h, F.lit(3)) == 0, F.shiftleft(h, 8)).otherwise(h)

    table = hashtable.build_hash_table(hashtable.entries(df, crowded, 8))
    assert table.agg(F.max(F.size("entries"))).first()[0] <= 16
    assert table.agg(F.sum(F.size("entries"))).first()[0] == 250
    found = hashtable.probe(df, table, crowded, 8)
    assert {r["word"] for r in found.collect() if r["found_idx"] is not None} == set(words)
    unknown = spark.createDataFrame([("nowhere",)], "word string")
    assert hashtable.probe(unknown, table, H.xor_rotate_hash, 8).first()["found_idx"] is None


def test_an_index_must_fit(spark):
    df = spark.createDataFrame([(1 << 24, "w")], "idx bigint, word string")
    with pytest.raises(Exception, match="does not fit"):
        hashtable.entries(df, H.xor_rotate_hash).collect()


@pytest.mark.parametrize("vec", [None, [1.0]])
def test_many_words_are_not_broadcast(spark, vec):
    """Rows and text count, also without vectors."""
    words = spark.range(800_000).selectExpr("concat('a long word number ', id) AS word", "id AS idx")
    words = words.withColumn("vec", F.lit(vec).cast("array<float>"))
    docs = spark.createDataFrame([(1, "the cat")], "doc_id bigint, text string")
    plan = E.lookup_words(docs, words)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast)  Relation" not in plan and ("_hot" in plan or "MapInArrow" in plan)


TOKENS = [
    ("and/or", "and/or"), ("a=b+c", "a=b+c"), ("~user", "~user"), ("x^2", "x^2"), ("a|b", "a|b"), ("c:\\d", "c : \\d"),
    ("see http://a.b/c?d=e now", "see http : //a.b/c ? d=e now"), ("mail me@x.org", "mail me @ x.org"),
    ("cannot", "can not"), ("Cannot go", "Can not go"), ("I'm gonna", "I 'm gon na"), ("wanna, gotta", "wan na , got ta"),
    ("gimme lemme", "gim me lem me"), ("cannots", "cannots"), ("scannot", "scannot"),
    ("don't", "do n't"), ("they'll've", "they'll 've"), ("we're here", "we 're here"), ("John's", "John 's"),
    ("1,000 men", "1,000 men"), ("a, b", "a , b"), ("10:30", "10:30"), ("so: yes", "so : yes"), ("wait...", "wait ..."),
    ("end.", "end ."), ("Mr. x", "Mr. x"), ("one. Two", "one . Two"), ("(a)", "( a )"), ("[b]", "[ b ]"), ("{c}", "{ c }"),
    ("a--b", "a -- b"), ("well-known", "well-known"), ("50%", "50 %"), ("$5", "$ 5"), ("#tag", "# tag"), ("A&B", "A & B"),
    ("why?", "why ?"), ("no!", "no !"), ("a; b", "a ; b"), ('"q"', '" q "'), ("«q»", "« q »"), ("3.14", "3.14"), ("", ""),
]


def test_tokens_by_hand(spark):
    df = spark.createDataFrame([(a,) for a, _ in TOKENS], "text string")
    found = {r[0]: " ".join(r[1]) for r in df.select("text", X.tokenize(F.col("text"))).collect()}
    assert found == dict(TOKENS)


def test_most_collided_keeps_ties(spark):
    histogram = spark.createDataFrame([(1, 4), (2, 4), (3, 1)], "h bigint, n bigint")
    assert {r["h"] for r in hashtable.most_collided(histogram).collect()} == {1, 2}


def test_gaussian_vectors(spark):
    df = spark.range(400).select("id", draws.gaussian_vector(1, 50, F.col("id")).alias("v"))
    vectors = [r["v"] for r in df.orderBy("id").collect()]
    again = [r["v"] for r in df.repartition(7).orderBy("id").collect()]
    assert vectors == again and all(len(v) == 50 for v in vectors)
    flat = [x for v in vectors for x in v]
    assert abs(statistics.mean(flat)) < 0.03 and abs(statistics.pstdev(flat) - 1) < 0.03
    assert len({tuple(v) for v in vectors}) == 400
    columns = list(zip(*vectors))
    assert max(abs(statistics.correlation(columns[0], c)) for c in columns[1:]) < 0.25


def test_vectors_differ(spark):
    """A million draws are a million starts, so their vectors differ."""
    first = F.slice(draws.gaussian_vector(3, 3, F.col("id")), 1, 3)
    n = 200_000
    assert spark.range(n).select(first.alias("v")).distinct().count() == n


def test_uniform_draws(spark):
    found = [r[0] for r in spark.range(2000).select(draws.uniform(3, F.col("id"))).collect()]
    assert 0 <= min(found) and max(found) < 1 and abs(statistics.mean(found) - 0.5) < 0.03


def test_pad_vector(spark):
    df = spark.createDataFrame([([1.5, 2.5],)], "v array<float>")
    assert df.select(pad_vector(F.col("v"), 3)).first()[0] == [1.5, 2.5, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lookup_order_and_batches(spark, limit, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_BYTES", limit)
    text = " ".join(["the"] * 40 + ["odd", "cat", "odd", "the", "cat"])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "dog the")], "doc_id bigint, text string")
    words = spark.createDataFrame(
        [("the", 0, [1.0, 2.0]), ("cat", 1, [3.0, 4.0])], "word string, idx bigint, vec array<float>"
    )
    found = E.lookup_words(docs, words)
    filled = E.fill_unknown(found, 2, seed=4)
    batches = {(r["doc_id"], r["batch"]): r for r in E.vector_batches(filled, 10).collect()}
    tokens = [t for b in range(5) for t in batches[1, b]["tokens"]]
    assert tokens == text.split()
    vecs = [v for b in range(5) for v in batches[1, b]["vecs"]]
    assert vecs[0] == [1.0, 2.0] and vecs[41] == [3.0, 4.0] and len(vecs[40]) == 2
    assert vecs[40] != vecs[42]
    order = {(r["doc_id"], r["pos"]): r["out_pos"] for r in E.batch_order(found, 10).collect()}
    assert [order[1, p] for p in range(40, 45)] == [43, 40, 44, 41, 42]
    rates = {r["doc_id"]: (r["in_vocab"], r["out_vocab"]) for r in E.known_rate(found).collect()}
    assert rates == {1: (43, 2), 3: (1, 1)}


@pytest.mark.parametrize("text,tokens", [("abc\u0085 def", ["def"]), ("a\u2028 CANNOT. Gonna", ["CAN", "NOT", "Gon", "na"])])
def test_letters_end_where_the_token_ends(spark, text, tokens):
    """As in the SQL; a character that ends a line is no letter."""
    assert value(spark, X.preprocess_text, text) == tokens
    assert value(spark, lambda c: X.keep_alpha(X.tokenize(c)), text) == tokens


def test_rules_are_skipped_only_where_they_do_nothing(spark):
    rng = random.Random(3)
    bits = [*" \t.,:'’-()[]<@\"…«!0é", *[" "] * 9, "can", "Cannot", "not", "LEMME", "wanna", "n't", "'S", "..", "--", ".'", "Word", "it"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "c string")
    plain = F.concat(F.lit(" "), F.col("c"), F.lit(" "))
    for pattern, replacement in X.TOKEN_RULES:
        plain = F.regexp_replace(plain, pattern, replacement.replace("\\", "$"))
    every = F.array_remove(F.split(plain, r"\s+"), "")
    assert df.where(~X.tokenize(F.col("c")).eqNullSafe(every)).count() == 0


def test_tokens_are_made_once(spark):
    """Documents whose tokens are made already give the same lookups, also by a join."""
    docs = spark.createDataFrame([(1, "The cat -- the cat's hat."), (2, None), (3, "a b"), (4, "")], "doc_id bigint, text string")
    words = spark.createDataFrame([("cat", 0, [1.0]), ("the", 1, [2.0])], "word string, idx bigint, vec array<float>")
    expected = sorted(map(str, E.lookup_words(docs, words).collect()))
    kept = E.tokenized(docs)
    assert "regexp" not in E.token_rows(kept)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, E.lookup_words(kept, words).collect())) == expected
    assert sorted(map(str, E.lookup_shuffled(docs, words).collect())) == expected


def test_words_are_looked_at_once(spark):
    from clickloom.operators import sentences as N

    docs = spark.createDataFrame([("etc. (etc. cat etc cat. cat",)] * 3, "text string")
    counts = N.period_counts(docs)
    assert sorted(map(tuple, counts.collect())) == [("cat", 9, 3), ("etc", 9, 6)]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
