import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import evaluation as EV
from hitweave.operators import matching as MT
from hitweave.sources.sinks import summary_lines


def reconstruction(spark):
    """Two events with the same ids: purity exactly one half, a short track, a duplicate."""
    data = [
        (1, 0, 1, 5), (1, 1, 1, 5), (1, 2, 1, 5), (1, 3, 2, 5), (1, 4, 2, 5), (1, 5, 3, 6), (1, 6, 3, 0), (1, 7, -1, 6),
        (2, 0, 1, 6), (2, 1, 1, 6), (2, 2, 1, 5),
    ]
    return spark.createDataFrame(data, "event_id long, hit_id long, track_id long, particle_id long")


def particles(spark):
    return spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.0), (2, 5, 0.5), (2, 6, 2.0)], "event_id long, particle_id long, pt double")


def test_matching_and_summary(spark, rows):
    table = MT.matching_table(reconstruction(spark), particles(spark), {"pt": 1.0}, min_track_length=2)
    with pytest.raises(ValueError):
        MT.match(table, 0.4)
    with pytest.raises(ValueError):
        MT.match(table, 0.5, "odd")
    matched = MT.match(table)
    assert rows(matched.where("is_matched"), "event_id", "track_id", "particle_id") == [
        (1, -1, 6), (1, 1, 5), (1, 2, 5), (2, 1, 6),
    ]
    two_way = MT.match(table, 0.5, "two_way")
    assert rows(two_way.where("is_matched"), "event_id", "track_id", "particle_id") == [(1, 1, 5), (2, 1, 6)]
    s = MT.tracking_summary(matched).first()
    assert (s.n_particles, s.n_reconstructed_particles, s.n_tracks, s.n_matched_tracks, s.n_duplicates) == (3, 2, 4, 3, 1)
    assert s.efficiency == pytest.approx(2 / 3) and s.fake_rate == pytest.approx(0.25) and s.duplication_rate == 0.5
    text = [r.value for r in summary_lines(MT.tracking_summary(matched)).orderBy("line").collect()]
    assert text[0] == "Number of reconstructed particles: 2" and text[5] == "Efficiency: 0.667" and len(text) == 8


def test_reconstruction_takes_last_write(spark, rows):
    labelled = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, -1)], "event_id long, hit_id long, track_id long")
    t = spark.createDataFrame([(1, 0, 0, 1, 5), (1, 1, 1, 0, 6)], "event_id long, track_edge_id long, src long, dst long, particle_id long")
    assert rows(MT.reconstruction_table(labelled, t), "hit_id", "track_id", "particle_id") == [(0, 7, 6), (1, 7, 5), (2, -1, 0)]


def test_bins_hold_their_upper_end(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (2.1,), (-0.1,)], "v double")
    assert rows(df.select("v", EV.bin_of("v", [0.0, 1.0, 2.0]).alias("b")).where("b is not null")) == [
        (0.0, 0), (0.5, 0), (1.0, 1), (2.0, 1),
    ]
    assert rows(df.select("v", EV.uniform_bin("v", 0.0, 2.0, 2).alias("b")).where("b is not null")) == [
        (0.0, 0), (0.5, 0), (1.0, 1), (2.0, 1),
    ]
    eff = EV.binned_efficiency(df, "v", [0.0, 1.0, 2.0], F.col("v") > 0.2, F.col("v") < 2.0)
    assert rows(eff, "bin", "n_total", "n_passed", "efficiency") == [(0, 2, 1, 0.5), (1, 1, 1, 1.0)]
    assert EV.log_bins(1, 100, 3) == pytest.approx([1, 10, 100]) and EV.linear_bins(0, 1, 3) == [0, 0.5, 1]
    with_bars = EV.add_interval(eff).collect()
    assert all(0 <= r.err_low <= 1 and 0 <= r.err_high <= 1 for r in with_bars)


def test_roc_and_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    data = [(bool(y), float(s)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20)]
    df = spark.createDataFrame(data, "y boolean, score double")
    curve = EV.roc_curve(df, F.col("y"))
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert EV.area_under_curve(curve).first().auc == pytest.approx(wins / (len(pos) * len(neg)))
    for r in curve.collect():
        assert r.tpr == pytest.approx(sum(p >= r.threshold for p in pos) / len(pos))
        assert r.fpr == pytest.approx(sum(n >= r.threshold for n in neg) / len(neg))


def test_losses(spark):
    df = spark.createDataFrame(
        [(True, 1.0, 2.0), (True, -0.5, 1.0), (True, 0.0, 9.0), (False, 1.0, -800.0), (False, 2.0, 800.0)],
        "y boolean, weight double, output double",
    )
    r = EV.weighted_log_loss(df).first()
    assert (r.n_pos, r.n_neg) == (1, 3)
    neg = 0.5 * np.log1p(np.exp(1.0)) + 0.0 + 2 * 800
    assert r.loss == pytest.approx((np.log1p(np.exp(-2.0)) + neg) / 4)
    h = EV.weighted_hinge_loss(df.withColumn("distance", F.abs("output") / 10), 1.0).first()
    assert h.pos_loss == pytest.approx(0.2)
    assert h.neg_loss == pytest.approx((0.5 * 0.9 + 0 + 0) / 3)


def test_score_histogram_kinds(spark, rows):
    df = spark.createDataFrame(
        [(1, True, 1.0, 0.0), (1, True, 0.0, 0.5), (2, False, 1.0, 1.0), (2, False, 0.0, 1.0)],
        "event_id long, y boolean, weight double, score double",
    )
    whole = EV.score_histogram(df, 10)
    assert whole.count() == 30
    assert rows(whole.where("n > 0"), "bin", "kind", "n", "n_per_event") == [
        (0, "Target True", 1, 0.5), (5, "Non-target True", 1, 0.5), (9, "Fake", 1, 0.5), (9, "Non-target True", 1, 0.5),
    ]


def test_empty_bins_and_events_without_edges(spark, rows):
    df = spark.createDataFrame([(0.5, True), (2.5, False)], "v double, p boolean")
    out = EV.binned_efficiency(df, "v", [0.0, 1.0, 2.0, 3.0, 4.0], F.col("p"))
    assert rows(out, "bin", "n_total", "n_passed", "efficiency") == [(0, 1, 1, 1.0), (1, 0, 0, 0.0), (2, 1, 0, 0.0), (3, 0, 0, 0.0)]
    grid = spark.createDataFrame([(0.1, 0.1, True)], "z double, r double, p boolean")
    out = EV.binned_ratio_2d(grid, F.col("p"), F.lit(True), (0.0, 1.0, 2), (0.0, 1.0, 2))
    assert rows(out, "z_bin", "r_bin", "n_denominator", "ratio") == [(0, 0, 1, 1.0), (0, 1, 0, None), (1, 0, 0, None), (1, 1, 0, None)]
    events = spark.createDataFrame([(1,), (2,), (2,)], "event_id long")
    edges = spark.createDataFrame([(1, 0.9), (1, 0.8)], "event_id long, score double")
    assert rows(EV.graph_size(edges, events)) == [(1.0, 1.0)]
    assert rows(EV.graph_size(edges)) == [(2.0, 0.0)]


def test_fit_and_scores_hold_no_fitted_object(spark):
    """Scores are the model's probabilities as plain columns, and the fit reads rows that were written."""
    import numpy as np

    from hitweave.operators import scoring as SC

    rng = np.random.default_rng(5)
    hits = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(rng.normal(size=40))], "event_id long, hit_id long, x double")
    rows = [(1, i, int(s), int(d), bool(rng.random() < 0.4 + 0.3 * (s > d)), float(rng.choice([1.0, 2.0, 0.0, -1.0])))
            for i, (s, d) in enumerate(rng.integers(0, 40, size=(300, 2)))]
    edges = spark.createDataFrame(rows, "event_id long, edge_id long, src long, dst long, y boolean, weight double")
    model = SC.fit_edge_classifier(edges, hits, ["x"], max_iter=100)
    scored = SC.apply_edge_classifier(model, edges, hits, ["x"])
    assert "UDF" not in scored._jdf.queryExecution().optimizedPlan().toString()
    x = {r.hit_id: r.x for r in hits.collect()}
    for r in scored.collect():
        margin = model.intercept + model.coefficients[0] * x[r.src] + model.coefficients[1] * x[r.dst]
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-12
    assert SC.mean_gradient(scored, hits, ["x"]).first().worst < 1e-3


def test_a_pair_meets_the_hits_once(spark, monkeypatch, rows):
    """Edges built in both directions are one row before they are turned outward."""
    from hitweave.plans import evaluation as PE

    hits = spark.createDataFrame([(1, h, float(9 - h), 0.0) for h in range(4)], "event_id long, hit_id long, r double, z double")
    built = [(1, 10, 0, 1, 0.2), (1, 11, 1, 0, 0.8), (1, 12, 2, 3, 0.5), (1, 13, 3, 2, 0.5), (1, 14, 0, 3, 0.1), (1, 15, 0, None, 0.9)]
    edges = spark.createDataFrame(built, "event_id long, edge_id long, src long, dst long, score double")
    track = spark.createDataFrame([(1, 0, 1, 7, 2.0), (1, 1, 0, 6, 3.0), (1, 1, 2, 8, 4.0)], "event_id long, src long, dst long, track_edge_id long, pt double")
    turned, orient = [], PE.orient_outward
    monkeypatch.setattr(PE, "orient_outward", lambda e, *a, **k: turned.append(e.count()) or orient(e, *a, **k))
    pairs, true = PE.outward_pairs(hits, edges, track)
    assert rows(pairs, "src", "dst", "edge_id", "score") == [(1, 0, 11, 0.8), (3, 0, 14, 0.1), (3, 2, 12, 0.5)]
    assert rows(true, "src", "dst", "track_edge_id", "pt", "edge_id") == [(1, 0, 6, 3.0, 11), (2, 1, 8, 4.0, None)]
    assert turned[0] == 3
