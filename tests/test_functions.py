from math import comb, exp, lgamma, log

import pytest
from pyspark.sql import functions as F

from editloom.functions import seq, special

CODE = {a + b + c: special_aa for (a, b, c), special_aa in zip(((a, b, c) for a in "TCAG" for b in "TCAG" for c in "TCAG"), seq.AMINO_ACIDS)}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("k, n, p", [(3, 10, 0.2), (1, 50, 0.01), (200, 1000, 0.21), (5, 5, 0.9), (0, 7, 0.3), (8, 7, 0.3)])
def test_binomial_tails(spark, k, n, p):
    want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    row = one(spark, sf=special.binom_sf(F.lit(float(k)), F.lit(float(n)), F.lit(p)), cdf=special.binom_cdf(F.lit(float(k)), F.lit(float(n)), F.lit(p)))
    assert row.sf == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert row.cdf == pytest.approx(1 - want + (comb(n, k) * p**k * (1 - p) ** (n - k) if k <= n else 0), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("n", [100_000, 1_000_000])
def test_large_binomial_tail_needs_more_steps(spark, n):
    p, k = 0.007, int(n * 0.007 * 1.02)
    pmf = lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))
    want = sum(pmf(i) for i in range(k, k + 3000))
    assert one(spark, v=special.binom_sf(F.lit(float(k)), F.lit(float(n)), F.lit(p), steps=400)).v == pytest.approx(want, rel=1e-6)


def test_error_test_equals_the_plain_sum(spark):
    k, n, t, c = 3, 40, 0.05, 0.03
    pmf = lambda i, p: comb(n, i) * p**i * (1 - p) ** (n - i)
    want, term, i = 0.0, 1.0, 0
    while term > 1e-6:
        term = pmf(i, c) * sum(pmf(j, t) for j in range(i + k, n + 1))
        want, i = want + term, i + 1
    assert one(spark, v=special.binom_minus_binom(F.lit(k), F.lit(t), F.lit(c), F.lit(n))).v == pytest.approx(want, rel=1e-9)


def test_f_t_and_normal_tails(spark):
    row = one(spark, f=special.f_sf(F.lit(4.0), F.lit(2.0), F.lit(10.0)), t=special.t_two_sided(F.lit(2.0), F.lit(10.0)), z=special.normal_two_sided(F.lit(-1.959964)))
    assert row.f == pytest.approx((1 + 4 * 2 / 10) ** -5, rel=1e-9)
    assert row.t == pytest.approx(0.0733880347707, rel=1e-8) and row.z == pytest.approx(0.05, abs=1e-6)


def plain_translate(s, frame, position, strand):
    at = position + 9
    if strand == "-":
        s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        at = len(s) - at - 1
    first = next(i for i in range(3) if (i - at) % 3 == (1 - frame) % 3)
    return "".join(CODE[s[i : i + 3]] for i in range(first, len(s) - 2, 3))


def test_translation_in_every_frame_and_strand(spark):
    s = "ATGTAACGCTTGACCATGGGATCCTTAAGC"
    rows = [(s, f, p, st) for f in (1, 2, 3) for p in range(0, 20) for st in "+-"]
    df = spark.createDataFrame(rows, "s string, f int, p int, st string")
    for r in df.select("*", seq.translate_frame(F.col("s"), F.col("f"), F.col("p"), F.col("st")).alias("aa")).collect():
        assert r.aa == plain_translate(r.s, r.f, r.p, r.st)
    assert one(spark, v=seq.translate_frame(F.lit(s), F.lit(None).cast("int"), F.lit(3), F.lit("+"))).v == ""


@pytest.mark.parametrize(
    "start, end, mh, want",
    [(10, 12, 0, 0), (10, 12, 1, 0), (10, 12, 6, 5), (12, 14, 3, 0), (11, 13, 2, 1), (13, 20, 5, 2), (17, 26, 3, 2), (13, 24, 7, 6)],
)
def test_left_shift(spark, start, end, mh, want):
    """mh 0; ties between the two centres; a long indel that does and does not reach the nick."""
    assert one(spark, v=seq.left_shift(F.lit(start), F.lit(end), F.lit(mh))).v == want


def test_haplotype_functions(spark):
    row = spark.createDataFrame([({"C6": "T", "A5": ".", "C10": "C"},)], "hap map<string,string>").select(
        seq.hap_text(F.col("hap")).alias("text"), seq.n_edits(F.col("hap")).alias("n"), seq.is_edited(F.col("hap")).alias("e"),
        seq.hap_text(seq.impute(F.col("hap"))).alias("full"), seq.has_edit(F.col("hap"), "C", ("G", "A")).alias("ga"), seq.apply_haplotype(F.lit("A" * 15 + "C" + "A" * 14), F.col("hap")).alias("w"),
    ).first()
    assert (row.text, row.n, row.e, row.full, row.ga) == ("A5=.,C6=T,C10=C", 1, True, "A5=A,C6=T,C10=C", False)
    assert row.w == "A" * 14 + "." + "T" + "A" * 14


def test_small_text_functions(spark):
    row = one(
        spark, c=seq.context(F.lit("ACGTACGT"), F.lit(1), 2), d=seq.context(F.lit("ACGTACGT"), F.lit(2), 2), rc=seq.reverse_complement(seq.reverse_complement(F.lit("ACCGT"))),
        run=seq.run_length(F.lit("CCC"), F.lit(2)), none=seq.run_length(F.lit("CCA"), F.lit(2)), a=seq.label(F.lit(10), 11), b=seq.label(F.lit(11), 11), x=seq.logit(F.lit(1.0)), y=seq.expit(F.lit(0.0)),
    )
    assert (row.c, row.d, row.rc, row.run, row.none, row.a, row.b, row.x, row.y) == (None, "ACTA", "ACCGT", 3, 0, "-1", "+1", None, 0.5)


def test_tails_of_batches_equal_those_of_columns(spark):
    import random

    from editloom.functions import special, tails

    draw = random.Random(5)
    rows = [(float(draw.randint(1, 60)), 10.0 ** -draw.uniform(1, 4), 10.0 ** -draw.uniform(1, 4), float(draw.randint(100, 3000)), draw.expovariate(0.3)) for _ in range(200)] + [(5.0, 0.01, 0.01, 300.0, None)]
    df = spark.createDataFrame(rows, "k double, t double, c double, n double, f double")
    pairs = [(m.binom_minus_binom(F.col("k"), F.col("t"), F.col("c"), F.col("n")), m.f_sf(F.col("f"), F.col("k"), F.col("n"))) for m in (special, tails)]
    for r in df.select(*[c.alias(f"{i}{j}") for i, both in enumerate(pairs) for j, c in enumerate(both)]).collect():
        assert r["10"] == pytest.approx(r["00"], abs=1e-10)
        assert (r["11"] is None) == (r["01"] is None) and (r["01"] is None or r["11"] == pytest.approx(r["01"], rel=1e-9, abs=1e-13))
