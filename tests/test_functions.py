import math
import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import ids as I
from tessera.functions import scores as S
from tessera.functions import text as X


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_code_tokens_of_comments_names_and_signs(spark):
    text = '// Reads ONCE, über 2\nlet HTTPPort_9=open("é")?; /* two\nlines */ a_b'
    want = ["reads", "once", "über", "2", "let", "http", "port", "9", "=", "open", "(", '"', "é", '"', ")", "?", ";", "two", "lines", "a", "b"]
    assert X.code_tokens_py(text) == want
    assert one(spark, [(text,)], "t string", X.code_tokens(F.col("t"))) == [want]


def test_code_tokens_equal_plain_reading(spark):
    rng = random.Random(3)
    parts = ["//", "/*", "*/", "/", "*", "\n", " ", "fooBar", "HTTPServer2X", "_", "é", "É", "x", "9", '"', "http://a", "::", "日", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(1500)] + ["", None]
    got = one(spark, [(t,) for t in texts], "t string", X.code_tokens(F.col("t")))
    assert got == [X.code_tokens_py(t) for t in texts]


def test_identifier_words(spark):
    names = ["parseJSON_v2", "FooBar_baz", "XMLHttpRequest", "a1B2", "__x__", "ABC", ""]
    want = [["parse", "json", "v2"], ["foo", "bar", "baz"], ["xml", "http", "request"], ["a1b2"], ["x"], ["abc"], []]
    assert one(spark, [(n,) for n in names], "t string", X.split_identifier(F.col("t"))) == want


def test_budgets_and_lines(spark):
    texts = ["", "abcd", "abcde", "abcdefgh", "abcdefghi"]
    assert one(spark, [(t,) for t in texts], "t string", X.approx_tokens(F.col("t"))) == [0, 1, 2, 2, 3]
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert one(spark, [(letters,)], "t string", X.trim_to_tokens(F.col("t"), 3)) == [letters[:12]]
    assert one(spark, [(letters,)], "t string", X.trim_to_tokens(F.col("t"), 10)) == [letters]
    assert one(spark, [(b,) for b in (0, 1000, 2000, 4000, 99999)], "t long", X.top_k_for_budget(F.col("t"))) == [5, 5, 10, 20, 20]
    assert one(spark, [("a\nb\nc",), ("a\nb",)], "t string", X.truncate_lines(F.col("t"), 2)) == ["a\nb\n... [truncated]", "a\nb"]


def test_splice_from_the_end(spark):
    edit = "array<struct<start:bigint,end:bigint,text:string>>"
    rows = [(bytearray("0123456789é".encode()), [(0, 2, "A"), (8, 99, "Z"), (5, 3, "no"), (4, 4, "+")])]
    got = one(spark, rows, f"c binary, e {edit}", F.decode(X.splice(F.col("c"), F.col("e")), "UTF-8"))
    assert got == ["A23+4567Z"]


def test_normalisation_known_cases(spark):
    df = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "s double").coalesce(1)
    take = lambda xs, c: [r[0] for r in df(xs).select(c).collect()]
    assert sorted(take([10, 20, 15], S.minmax(F.col("s")))) == [0, 0.5, 1]
    assert take([5, 5], S.minmax(F.col("s"))) == [0, 0]
    assert np.allclose(sorted(take([1, 2, 3], S.zscore(F.col("s")))), [-1.2247, 0, 1.2247], atol=1e-4)
    assert np.allclose(take([0, 0.5, 1], S.logistic(F.col("s"), 0.5, 10)), [0.00669, 0.5, 0.99331], atol=1e-5)
    assert take([], S.minmax(F.col("s"))) == []


def test_vector_functions(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for _ in range(20)] + [([0.0] * 5, [1.0] * 5)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>").select(S.l2_squared(F.col("a"), F.col("b")), S.cosine(F.col("a"), F.col("b")), S.normalize(F.col("a"))).collect()
    for (a, b), (d, c, n) in zip(rows, got):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        size = np.linalg.norm(a)
        assert math.isclose(d, ((a - b) ** 2).sum(), rel_tol=1e-9)
        assert math.isclose(c, a @ b / size / np.linalg.norm(b) if size else 0.0, rel_tol=1e-9, abs_tol=1e-12)
        assert np.allclose(n, a / size if size else a)
    pooled = one(spark, [([[1.0, 0.0], [5.0, 5.0], [0.0, 1.0]], [1, 0, 1])], "v array<array<double>>, m array<int>", S.mean_pool(F.col("v"), F.col("m")))
    assert np.allclose(pooled[0], [0.5**0.5] * 2)


def test_ids_equal_the_standard_library(spark):
    names = ["", "a", "é\x1fx", "long" * 500]
    got = one(spark, [(n,) for n in names], "n string", I.uuid5(I.PROJECT, F.col("n")))
    assert got == [str(uuid.uuid5(I.PROJECT, n)) for n in names]
    got = one(spark, [("p", "m", 384)], "p string, m string, d int", I.embedding_set_id(F.col("p"), F.col("m"), F.col("d")))
    want = int.from_bytes(uuid.uuid5(I.PROJECT, "p\x1fm\x1f384").bytes[:8], "big", signed=False)
    assert got[0] % 2**64 == want
    unit = lambda f: I.compilation_unit_id(F.lit("n"), F.lit("t"), F.lit("x"), F.lit("p"), F.array(*map(F.lit, f)))
    row = spark.range(1).select(unit(["b", "a", "b"]).alias("x"), unit(["a", "b"]).alias("y"), unit(["a", "c"]).alias("z")).first()
    assert row.x == row.y != row.z
    assert one(spark, [("a-b/c", 3)], "m string, d int", I.relation_name(F.col("m"), F.col("d"))) == ["emb_a_b_slash_c_3"]
