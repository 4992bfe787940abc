"""Severity against a plain likelihood and plain scores, licence cosines against plain sums, and inheritance against a walk up the folders."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import license_scan, toxicity


def plain_loss(rows, w, t, ridge=1.0):
    total = ridge / 2 * sum(x * x for x in w)
    for grade, found in rows:
        eta = sum(w[f] for f in found)
        above = [1.0, *[1 / (1 + math.exp(x - eta)) for x in t], 0.0]
        total -= math.log(max(above[grade] - above[grade + 1], 1e-12))
    return total


@pytest.mark.parametrize("grades", [2, 3])
def test_fit_is_the_least_of_the_penalised_likelihood(grades):
    r = random.Random(grades)
    true = [r.gauss(0, 2) for _ in range(6)]
    rows = []
    for _ in range(400):
        found = sorted({r.randrange(6) for _ in range(r.randint(0, 3))})
        eta = sum(true[f] for f in found) + math.log((u := r.uniform(0.001, 0.999)) / (1 - u))
        rows.append((sum(eta > x for x in (0.5, 2.0)[: grades - 1]), found))
    w, t = toxicity.fit_ordinal(rows, 6, grades)
    best = plain_loss(rows, w, t)
    assert list(t) == sorted(t)
    for i in range(6 + len(t)):
        for step in (-0.02, 0.02):
            other = np.concatenate([w, t])
            other[i] += step
            assert plain_loss(rows, other[:6], other[6:]) > best


def test_scores_are_sums_over_the_words_of_whole_texts(spark):
    r = random.Random(3)
    model = toxicity.SeverityModel({f"w{i}".encode(): r.gauss(0, 1) for i in range(12)} | {"é1".encode(): 0.7}, [0.4, 1.9], 0.3)
    texts = [" ".join(r.choice(["W1", "w2", "w3,w4", "é1", "É1", "other", "w11."]) for _ in range(r.choice([0, 1, 5, 4000]))) for _ in range(40)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in toxicity.score_severity(docs, model).collect():
        words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[row["doc_id"]] or "")))
        eta = sum(model.weights.get(x.encode(), 0.0) for x in words)
        above = [1 / (1 + math.exp(x - eta)) for x in model.thresholds]
        assert math.isclose(row["expected_severity"], sum(above), abs_tol=2e-6) and math.isclose(row["p_toxic"], above[0], abs_tol=2e-6)
        assert row["toxic"] == (row["p_toxic"] >= 0.3)


def terms(text):
    return [x for x in re.split(" +", re.sub(r"[^\w.]+|_|\.(?!\d)|(?<!\d)\.", " ", text.lower())) if x]


def test_best_template_by_plain_cosines(spark):
    r = random.Random(8)
    words = "licensed under the mit apache license version 2.0 permission granted free copy software foo bar baz".split()
    templates = {name: tuple(" ".join(r.choice(words) for _ in range(r.randint(4, 9))) for _ in range(2)) for name in ("A", "B", "C")}
    lines = [" ".join(r.choice([*words, f"x{r.randrange(30)}"]) for _ in range(r.randint(1, 12))) for _ in range(80)] + ["", templates["A"][0], templates["B"][1].upper() + "!"]
    rows = [(str(i), line, r.choice([0, 1, 1, 3])) for i, line in enumerate(lines)]
    got = {x["id"]: (x["license"], x["score"], x["n_words"], x["n_known"]) for x in license_scan._best(spark.createDataFrame(rows, "id string, line string, times int"), templates, 0.3).collect()}
    notices = [(name, Counter(terms(t))) for name, texts in templates.items() for t in texts]
    own, df = Counter(t for _, c in notices for t in c), Counter()
    for _, line, times in rows:
        for t in set(terms(line)):
            df[t] += times
    total = sum(times for *_, times in rows)
    idf = {t: 1 + math.log((total + len(notices) + 1) / (df[t] + own[t] + 1)) for t in own}
    want = {}
    for name, line, _ in rows:
        tf = Counter(terms(line))
        norm = math.sqrt(sum((n * idf.get(t, 1.0)) ** 2 for t, n in tf.items()))
        tries = []
        for licence, c in notices:
            size = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
            dot = sum(tf[t] * idf[t] * n * idf[t] / size for t, n in c.items() if t in tf)
            score = round(dot / norm, 6) if norm else 0.0
            if dot and score >= 0.3:
                tries.append((-score, licence, sum(tf.values()), sum(tf[t] for t in c)))
        if tries:
            best = min(tries, key=lambda x: x[:2])
            want[name] = (best[1], -best[0], *best[2:])
    assert len(want) > 20 and got.keys() == want.keys()
    for i, (licence, score, n, known) in want.items():
        assert got[i][0] == licence and math.isclose(got[i][1], score, abs_tol=2e-6) and got[i][2] == n and (got[i][3] == known or len({x for x, c in notices if x == licence}) == 1)


def test_licences_come_down_from_the_nearest_folder(spark):
    r = random.Random(4)
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g", "e/f/g/h"]
    rows = [(i, r.choice([mit, gpl, "plain words only", "plain words only", None]) if i % 3 == 0 else "plain words only", f"{r.choice(folders)}/file{i}".lstrip("/") if r.random() > 0.05 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(4)
    got = {x["doc_id"]: x for x in license_scan.scan(docs, F.col("path")).collect()}
    score = {x["license"]: x["score"] for x in got.values() if x["via"] == "header"}
    assert set(score) == {"MIT", "GPL-3.0"}
    licensed = {}
    for i, text, path in rows:
        if text in (mit, gpl) and path and "/" in path:
            name = "MIT" if text == mit else "GPL-3.0"
            licensed.setdefault(path.rsplit("/", 1)[0], []).append((-score[name], path, name))
    for i, text, path in rows:
        parts = path.split("/")[:-1] if path else []
        up = next((d for n in range(len(parts), 0, -1) if (d := "/".join(parts[:n])) in licensed), None)
        want = ("MIT", "header", None) if text == mit else ("GPL-3.0", "header", None) if text == gpl else (min(licensed[up])[2], "inherited", up) if up else (None, "none", None)
        assert (got[i]["license"], got[i]["via"], got[i]["licensed_dir"]) == want
