import random
import re
from fractions import Fraction

from vacantia.llm.license_scan import LEAST_DICE, TEMPLATES, marker_words, scan_licenses, size_bounds, template_bigrams


def brute(text):
    found = []
    lines = (text or "").split("\n")
    paragraphs = [p for p in re.split("\n[ \t\r]*\n", text or "") if "\n" in p.strip(" ")]
    for unit, part in enumerate(lines + paragraphs):
        own = set(template_bigrams(re.sub("[^A-Za-z0-9]", " ", part)))
        fits = []
        for name, texts in TEMPLATES.items():
            for template in texts:
                wanted = set(template_bigrams(template))
                if own and 2 * len(own & wanted) >= LEAST_DICE * (len(own) + len(wanted)):
                    fits.append((Fraction(2 * len(own & wanted), len(own) + len(wanted)), name, unit))
        best = max((f[0] for f in fits), default=0)
        found += [(name, unit) for dice, name, unit in fits if dice == best]
    return sorted(found)


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, matches int")
    rows = scan_licenses(docs.drop("matches")).collect()
    return {row.doc_id: sorted((m.licence, m.unit) for m in row.matches) for row in rows}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    notices = [t for texts in TEMPLATES.values() for t in texts]
    texts = [None, "", "licensed", "under", "a\n\n\nb", "word " * 50_000, "\n".join(notices), "É licensed under CC BY-NC 4.0!"]
    for _ in range(150):
        words = rng.choice(notices).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["the", "x", "License,", "", "\n"])
        texts.append(rng.choice(["", "some prose\n", "prose "]) + " ".join(words).upper() + rng.choice(["", "\nmore", "\n\nmore"]))
    assert scan(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_empty_table_and_no_templates(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert scan_licenses(docs).collect() == []
    assert scan_licenses(spark.createDataFrame([(1, "x y")], docs.schema), templates={}).first().matches == []


def test_bounds_and_markers_lose_nothing():
    for size in range(1, 80):
        low, high = size_bounds(size, LEAST_DICE)
        for other in range(1, 200):
            reachable = 2 * min(size, other) >= LEAST_DICE * (size + other)
            assert reachable == (low <= other <= high)
    rng = random.Random(3)
    sets = [template_bigrams(t) for texts in TEMPLATES.values() for t in texts]
    markers = set(marker_words(sets, LEAST_DICE))
    for wanted in sets:
        for _ in range(200):
            own = {b for b in wanted if rng.random() < 0.85} | {f"x{i} y" for i in range(rng.randint(0, 3))}
            if 2 * len(own & set(wanted)) >= LEAST_DICE * (len(own) + len(wanted)):
                assert any(set(b.split()) & markers for b in own)


def test_plan_has_no_python_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
