"""Registered queries do the whole job: compared with brute force on small tables of their own."""

import hashlib
from collections import defaultdict

import pytest

from strandlab.plans import twins


def draw(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("name", ["diff_selectivity", "diff_last_query"])
def test_selectivity_of_all_vectors(spark, tmp_path, name):
    """Vectors on both sides of id 60 take part, and ids needn't be dense."""
    ids = [0, 1, 2, 58, 59, 60, 61, 62, 75, 130, 131, 4999]
    spark.createDataFrame([(i,) for i in ids], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    scores = defaultdict(list)
    for i in ids:
        places = (i % 8, (i + 3) % 8)
        for layer in range(2):
            for head in range(4):
                sides = ([], [])
                for q in [7] if name == "diff_last_query" else range(8):
                    for k in range(8):
                        sides[k in places].append(round(draw(7, i, layer * 256 + head * 64 + q * 8 + k) / 2**32, 6))
                scores[f"m{i % 2}", "NL", layer, head].append(sum(sides[1]) / len(sides[1]) - sum(sides[0]) / len(sides[0]))
    got = {(r["model"], r["modality"], r["layer"], r["head"]): r for r in twins.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {k: r["n_pairs"] for k, r in got.items()} == {k: len(v) for k, v in scores.items()}
    for k, v in scores.items():
        assert abs(got[k]["score"] - sum(v) / len(v)) < 2e-6


def test_bootstrap_of_all_draws(spark, tmp_path):
    """The interval over the operator's default of 5000 draws."""
    difference = [0.5, -1.25, 3.0, 2.0, -0.75, 1.5, 4.25]
    rows = [(u, t, v) for u, d in enumerate(difference) for t, v in (("view", 10.0 + d), ("click", 10.0))]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    n, draws = len(difference), 5000
    pick = lambda b, i: int(hashlib.md5(f"7:{b}:{i // 4}".encode()).hexdigest()[8 * (i % 4) : 8 * (i % 4) + 8], 16) % n
    means = sorted(sum(difference[pick(b, i)] for i in range(n)) / n for b in range(draws))

    def at(p):
        k = int(p * (draws - 1))
        return means[k] + (p * (draws - 1) - k) * (means[k + 1] - means[k])

    (got,) = twins.QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()
    assert got["draws"] == draws and abs(got["low"] - at(0.025)) < 1e-4 and abs(got["high"] - at(0.975)) < 1e-4
