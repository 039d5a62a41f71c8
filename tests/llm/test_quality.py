"""Operator 5: counts by plain rules, the estimate against numpy, outliers."""
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SF_SMALL, SPACE, awkward, awkward_rows, empty, prose

from sqlforge.llm import quality as Q


def plain(text):
    text = text or ""
    w = SPACE.findall(text)
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    seen = Counter(windows)
    repeated = len({k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(3)})
    lines, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, len(w) < 50 or 100 * repeated > 50 * len(w)


def test_awkward_documents(spark):
    got = Q.judge(awkward(spark, clash=("vec", "kept"))).collect()
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(((r.doc_id, *r[1:7]) for r in got), key=key) == sorted(((r[0], *plain(r[1])) for r in awkward_rows()), key=key)
    assert not any(r.kept and r.base_failed for r in got)


def test_empty_and_all_failing(spark):
    assert Q.judge(empty(spark)).count() == 0
    assert [r.kept for r in Q.judge(awkward(spark).filter("doc_id in (4, 5, 8)")).collect()] == [False] * 5


def test_distances():
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (50, Q.DIM))
    a = r.normal(0, 1, (Q.DIM, Q.DIM))
    s = a @ a.T + np.eye(Q.DIM)
    m = r.normal(0, 1, Q.DIM)
    assert np.allclose(Q.distances(x, m, s), np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m))
    assert Q.chi_square(0.0, 8) == pytest.approx(7.344, abs=0.02) and Q.chi_square(2.326, 8) == pytest.approx(20.09, abs=0.1)


def plain_fit(x, start_mean, start_scatter, steps):
    """Concentration steps over all rows at once, with the same bin edges."""
    mean, scatter = start_mean, start_scatter
    for _ in range(steps):
        d = Q.distances(x, mean, scatter)
        edge = np.sort(Q.bins(d))[int(np.ceil(Q.SUPPORT * len(x) - 1e-9)) - 1]
        inside = x[Q.bins(d) <= edge]
        mean = inside.mean(axis=0)
        scatter = np.cov(inside.T, bias=True) + np.diag(np.square(list(Q.FLOORS.values())))
    return mean, scatter


def test_fit_equals_the_plain_one_and_resists_a_third_of_outliers(spark):
    good = [(k, prose(k, 60 + k % 50), "en", "s") for k in range(240)]
    bad = [(1000 + k, " ".join(w + "###$$" for w in prose(5000 + k, 70).split()), "en", "s") for k in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    stats = Q.statistics(df).cache()
    held = Q.blocks(stats, block_rows=32).cache()
    got = Q.fit(held).collect()
    assert len(got) == 1
    x = np.array([np.frombuffer(r.vec) for r in stats.collect() if not r.base_failed])
    floors = np.diag(np.square(list(Q.FLOORS.values())))
    a = plain_fit(x, x.mean(axis=0), np.cov(x.T, bias=True) + floors, Q.STEPS)
    mean, scatter = Q._decode(got[0].mean, got[0].scatter)
    assert np.allclose(mean, a[0], atol=1e-6) or np.linalg.slogdet(scatter)[1] <= np.linalg.slogdet(a[1])[1] + 1e-6
    judged = {r.doc_id: r for r in Q.judge(df).collect()}
    assert all(judged[r[0]].kept for r in good if not judged[r[0]].base_failed)
    assert not any(judged[r[0]].kept for r in bad)


def test_query_keeps_clean_documents(spark):
    from sqlforge.llm.quality import op5_robust_outliers
    sf = SF_SMALL.replace("0.001", "0.01")
    kept = {r.doc_id: r for r in op5_robust_outliers(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {d: tuple(r[1:7]) for d, r in kept.items()} == {d: plain(t) for d, t in texts.items()}
    clean = [kept[d].kept for d, q in labels.items() if q == 1 and not kept[d].base_failed]
    junk = [kept[d].kept for d, q in labels.items() if q == 0 and not kept[d].base_failed]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.1


def fits_of_groups(spark, rows):
    stats = Q.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    held = Q.blocks(stats).cache()
    languages = Q.fit(held.withColumn("g", held.over))
    return {r.g: Q._decode(r.mean, r.scatter) for r in Q.fit(held, towards=Q.targets(held, languages)).collect()}


def test_small_groups_are_fitted_on_their_own_and_never_across_languages(spark):
    """Other languages' documents change nothing; a group of 99 and one of 100 documents differ by little."""
    rows = [(k, prose(k, 60 + k % 50), "en", f"s{k % 4}") for k in range(160)]
    other = [(1000 + k, " ".join(w.upper() * 3 for w in prose(9000 + k, 80).split()), "de", f"s{k % 4}") for k in range(160)]
    alone, both = fits_of_groups(spark, rows), fits_of_groups(spark, rows + other)
    assert len(alone) == 4 and len(both) == 8
    for g, (mean, scatter) in alone.items():
        assert np.allclose(mean, both[g][0]) and np.allclose(scatter, both[g][1])
    more = [(k, prose(k, 60 + k % 50), "en", "s") for k in range(100)] + [(500 + k, prose(500 + k, 60 + k % 50), "en", "t") for k in range(300)]
    g = '{"lang":"en","source":"s"}'
    (a, s), (b, t) = fits_of_groups(spark, more[1:])[g], fits_of_groups(spark, more)[g]
    assert Q.distances(b[None], a, s)[0] < 0.1 and abs(np.linalg.slogdet(s)[1] - np.linalg.slogdet(t)[1]) < 1.0


def test_every_group_of_the_table_has_its_own_fit(spark):
    from sqlforge.llm.common import documents
    held = Q.blocks(Q.statistics(documents(spark, SF_SMALL.replace("0.001", "0.1")))).cache()
    languages = Q.fit(held.withColumn("g", held.over))
    got = Q.fit(held, towards=Q.targets(held, languages))
    assert languages.count() == held.select("over").distinct().count() == 4
    assert got.count() == held.select("g").distinct().count() == 80


def test_repetition_that_passes_the_base_rules_is_an_outlier(spark):
    """45 % duplicate lines, 40 to 50 % repeated words, or both, where no other document repeats."""
    def lines(k, copies):
        own = [prose(100 * k + j, 12) for j in range(11)]
        return "\n".join(own + [own[0]] * copies)

    clean = [(k, lines(k, 0), "en", "s") for k in range(300)]
    words = [(1000 + k, prose(70_000 + k, 60) + " " + prose(80_000, 5) + " " + " ".join(["once more now then"] * 12), "en", "s") for k in range(8)]
    both = [(2000 + k, "\n".join([x for x in lines(900 + k, 0).split("\n")][:11] + ["on and on it goes"] * 9 + ["it ends"]), "en", "s") for k in range(8)]
    df = spark.createDataFrame(clean + words + both, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert not any(got[r[0]].base_failed for r in clean + words + both)
    assert all(got[r[0]].n_repeat_words / got[r[0]].n_words < 0.5 for r in words + both)
    assert not any(got[r[0]].kept for r in words + both)
    assert np.mean([got[r[0]].kept for r in clean]) > 0.99


def test_cut_off_follows_chi_square_and_the_bulk():
    assert Q.cut_off(Q.chi_square(0.0), Q.chi_square(Q.UPPER_Z)) == pytest.approx(Q.chi_square(Q.TAIL_Z))
    assert Q.cut_off(3.2, 7.3) > 40 and Q.cut_off(1e-3, 5.0) < 150      # heavier tails; half of a group alike
    cov = np.diag(np.square(list(Q.FLOORS.values()))) * 4
    assert np.allclose(Q.raised(cov), cov) and np.allclose(Q.raised(cov * 0), cov / 4)
    r = np.random.default_rng(1)
    d = r.chisquare(8, 100_000)
    at, n = np.unique(Q.bins(d), return_counts=True)
    assert Q.quantile(at, n, 0.75) == pytest.approx(np.quantile(d, 0.75), rel=0.01)
