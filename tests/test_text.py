import math
from statistics import quantiles

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lurus.functions import stats as S
from lurus.functions import text as T


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return rows.select(column.alias("x")).first().x


def test_normal_forms(spark):
    got = lambda s, m: one(spark, T.normal(F.col("s"), m), s=s)
    assert got("  Apa　KABAR,\tdunia_1!  ", "lower_nopunct") == "apa kabar dunia_1"
    assert got("A  b", "raw") == "A  b"
    assert got(" A  b! ", "lower") == "a b!"
    assert got(None, "raw") == "" and got(None, "lower") == ""


def test_error_rates(spark):
    rate = lambda h, r, e: one(spark, T.rate(T.char_edits(F.col("h"), F.col("r")), F.length("r"), F.col("h"), e), h=h, r=r)
    assert rate("kepaIa", "kepala", "one") == 1 / 6
    assert rate("", "", "one") == 0 and rate("x", "", "one") == 1 and rate("x", "", "zero") == 0 and rate("xy", "", "edits") == 2
    assert one(spark, T.word_edits(F.col("h"), F.col("r")), h="saya makan roti", r="saya makan nasi") == 1
    assert one(spark, T.word_edits(F.col("h"), F.col("r")), h="", r="a b a") == 3


def words_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("a b é 😀 kata".split()), max_size=6), st.lists(st.sampled_from("a b é 😀 kata".split()), max_size=6)), min_size=20, max_size=30))
def test_word_distance_is_exact(spark, pairs):
    df = spark.createDataFrame([(" ".join(a), " ".join(b), words_distance(a, b)) for a, b in pairs], "a string, b string, d int")
    assert df.where(T.word_edits(F.col("a"), F.col("b")) != F.col("d")).count() == 0


def test_spacing_and_pieces(spark):
    assert one(spark, T.mend_spacing(F.col("s")), s="Halo , dunia ( baru ) !  Ya") == "Halo, dunia (baru)! Ya"
    assert one(spark, T.join_pieces(F.col("s")), s="[CLS] makan ##an enak , as * sila [SEP]") == "makanan enak, as*sila"
    assert one(spark, T.join_pieces(F.col("s")), s="##an x") == "an x"


def test_punctuation_parts(spark):
    parts = lambda s: tuple(one(spark, p, s=s) for p in T.punct_parts(F.col("s")))
    assert parts("$aya") == ("$", "aya", "")
    assert parts("***") == ("***", "", "")
    assert parts("(kata!)") == ("(", "kata", "!)")


def test_binomial_tail(spark):
    exact = lambda n, k: min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    for n, k in ((0, 0), (77, 38), (95, 31), (138, 67)):
        assert abs(one(spark, S.binomial_p(F.col("k"), F.col("n")), k=k, n=n) - exact(n, k)) < 1e-9
    assert abs(one(spark, S.binomial_p(F.col("k"), F.col("n")), k=1450, n=3000) - 0.07067) < 1e-4


def test_exclusive_percentiles(spark):
    values = sorted((i * 37 % 101) / 7 for i in range(57))
    cuts = quantiles(values, n=100)
    df = spark.createDataFrame([(values, i) for i in range(1, 100)], "v array<double>, i int")
    assert all(abs(r.x - cuts[r.i - 1]) < 1e-9 for r in df.select("i", S.exclusive_percentile(F.col("v"), F.col("i")).alias("x")).collect())


def test_f_scores(spark):
    f = lambda tp, fp, fn, b: one(spark, S.f_beta(F.lit(tp), F.lit(fp), F.lit(fn), b))
    assert f(0, 0, 0, 0.5) == 0 and f(5, 0, 0, 0.5) == 1
    assert f(1, 1, 0, 0.5) < f(1, 1, 0, 1.0)
