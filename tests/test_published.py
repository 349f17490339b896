"""Published measures and scores of one corpus of five clusters, and the correlations published for them."""

import pytest

from clusterloom.plans import runs

#: Cluster, Voorhees, overlap, KL divergence, density, nMRD, semantic similarity.
MEASURED = [
    ("business", 1.0, 0.13134583830833435, 7.495224031181163, 0.015801324307108892, 0.8147931059532019, 0.3630962669849396),
    ("entertainment", 1.0, 0.10018700733780861, 7.694680695577742, 0.015822601364611697, 0.8111438949281936, 0.3576897978782654),
    ("politics", 1.0, 0.1938476413488388, 6.881688071669072, 0.02049048760991207, 0.8897211338525725, 0.3177068829536438),
    ("sport", 1.0, 0.20812247693538666, 7.412371650546685, 0.017439049326731928, 0.9631213153465488, 0.417784184217453),
    ("tech", 1.0, 0.14029017090797424, 7.056399633380132, 0.020808654373957933, 0.8378313039980285, 0.32021957635879517),
]
#: Pearson's r and p, Spearman's r and p. A constant measure has no row; divergence is negated.
EXPECTED = {"overlap": (0.281, 0.6468, 0.1, 0.8729), "kl_divergence": (-0.625, 0.2592, -0.6, 0.2848), "density": (-0.627, 0.2577, -0.6, 0.2848), "nmrd": (0.541, 0.3462, 0.1, 0.8729)}


def test_correlations_of_published_measures(spark):
    quality = spark.createDataFrame([("news", *r[:3], -r[3], *r[4:6]) for r in MEASURED], "dataset string, cluster string, voorhees_nn double, overlap double, kl_divergence double, density double, nmrd double")
    scored = spark.createDataFrame([("news", r[0], r[6], 0.0) for r in MEASURED], "dataset string, cluster string, sem_sim double, tok_f1 double")
    rows = runs.correlation_table(quality, scored).collect()
    got = {r["measure"]: (r["pearson_r"], r["pearson_p"], r["spearman_r"], r["spearman_p"]) for r in rows if r["metric"] == "sem_sim"}
    assert got.keys() == EXPECTED.keys() and {r["n"] for r in rows} == {5} and len(rows) == 4
    for m, values in EXPECTED.items():
        assert got[m] == pytest.approx(values, abs=1e-9), m
