"""Steps whose work must grow no faster than their input, against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ancestra.operators import content, metrics, models, recover, temporal, walks
from ancestra.plans import catalog


def most_rows(df):
    """The most rows that one step of df's plan made, once run."""
    df.collect()
    most, held = 0, [df._jdf.queryExecution().executedPlan()]
    while held:
        node = held.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            held.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            held.append(node.plan())
        children = node.children()
        held += [children.apply(i) for i in range(children.size())]
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
    return most


def plain_negatives(edges, years, per):
    places = sorted(years, key=lambda i: (years[i], i))
    out = set()
    for source, cited in edges:
        high = sum(y <= years[source] for y in years.values())
        for c in range(1, per + 1):
            for a in range(1, temporal.ATTEMPTS + 1):
                draw = int(hashlib.md5(f"0|{source}|{cited}|{c}|{a}".encode()).hexdigest()[:8], 16) / 2**32
                target = places[int(draw * high)]
                if target != source and (source, target) not in edges:
                    out.add((source, cited, c, target))
                    break
    return out


def test_negatives_make_a_row_a_candidate(spark):
    years = {f"W{i}": 1990 + i // 10 for i in range(60)}
    rng = random.Random(1)
    edges = {(f"W{i}", f"W{rng.randrange(i)}") for i in range(1, 60) for _ in range(4)}
    nodes = spark.createDataFrame([(i, y) for i, y in years.items()], "id string, year int")
    cites = temporal.dated(spark.createDataFrame(sorted(edges), "source string, target string"), nodes)
    drawn = temporal.negatives(cites, nodes, cites, per=5)
    assert {tuple(r) for r in drawn.collect()} == plain_negatives(edges, years, 5)
    assert most_rows(drawn) <= 5 * len(edges)


def plain_average_precision(rows):
    told = sorted(rows, key=lambda r: r[2])
    told.sort(key=lambda r: (1, 0) if r[0] is None else (0, -r[0]))
    found, out = 0, []
    for k, r in enumerate(told, 1):
        found += r[1]
        if r[1]:
            out.append(found / k)
    return sum(out) / len(out)


def test_average_precision_parts_an_order(spark):
    rng = random.Random(2)
    rows = [("a", rng.choice([None, 0.0, 0.0, 1.0, 2.5]), int(rng.random() < 0.3), f"W{rng.randrange(10**6)}|{k}") for k in range(3000)]
    rows += [("b", rng.random(), int(rng.random() < 0.3), f"W{k}") for k in range(3000)]
    scored = spark.createDataFrame(rows, "scorer string, score double, label int, id string")
    ours = {r[0]: r[1] for r in metrics.average_precision(scored, ["scorer"]).collect()}
    for name in "ab":
        assert abs(ours[name] - plain_average_precision([r[1:] for r in rows if r[0] == name])) < 1e-9
    assert scored.groupBy(metrics._part(scored, "id").alias("p")).count().agg(F.max("count")).first()[0] < 1200


def test_roc_auc_parts_an_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, rng.random()]), int(rng.random() < 0.4)) for _ in range(2000)]
    scored = spark.createDataFrame(rows, "score double, label int").withColumn("scorer", F.lit("x"))
    key = [-1.0 if s is None else s for s, _ in rows]
    good, bad = ([k for k, (_, y) in zip(key, rows) if y == v] for v in (1, 0))
    told = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert abs(metrics.roc_auc(scored, ["scorer"]).first()["auc"] - told) < 1e-9
    ties = scored.groupBy("score").agg(F.count("*").alias("n"))
    assert ties.groupBy(metrics._part(ties, "score").alias("p")).count().agg(F.max("count")).first()[0] < 400


def tangled(seed, n=120):
    rng = random.Random(seed)
    pairs = {(f"w{i:03d}", f"w{rng.randrange(max(0, i - 12), i):03d}") for i in range(1, n) for _ in range(3)}
    pairs |= {(b, a) for a, b in pairs if rng.random() < 0.06}
    return pairs


def plain_knots(pairs):
    on = {}
    for a, b in pairs:
        on.setdefault(a, []).append(b)

    def after(x):
        seen, todo = set(), [x]
        while todo:
            new = set(on.get(todo.pop(), [])) - seen
            seen |= new
            todo += new
        return seen

    past = {x: after(x) for x in {y for p in pairs for y in p}}
    alike = {x: {y for y in past[x] if x in past[y]} | {x} for x in past}
    return {x: min(ys) for x, ys in alike.items() if len(ys) > 1}


@pytest.mark.parametrize("searched", [walks.SEARCHED, 60])
def test_knots_keep_no_row_a_pair(spark, monkeypatch, searched):
    """By the search of one task, and by rounds of joins where an origin has too many citations."""
    monkeypatch.setattr(walks, "SEARCHED", searched)
    graphs = {"o1": tangled(5), "o2": tangled(6)}
    rows = spark.createDataFrame([(o, a, b) for o, pairs in graphs.items() for a, b in pairs], "origin string, source string, target string")
    found = {(r.origin, r.id): r.knot for r in walks.knots(rows).collect()}
    assert found == {(o, x): k for o, pairs in graphs.items() for x, k in plain_knots(pairs).items()}
    assert len(set(found.values())) > 2


def test_mass_moves_alike_in_a_task_and_by_joins(spark, monkeypatch):
    graphs = {"w119": tangled(5), "w100": tangled(6)}
    rows = spark.createDataFrame([(o, a, b, 0.3) for o, pairs in graphs.items() for a, b in pairs], "origin string, source string, target string, w double")
    origins = rows.select("origin").distinct()
    one = {(r.origin, r.id): r.mass for r in walks.propagate(rows, origins, 1e-9, 12).collect()}
    monkeypatch.setattr(walks, "SEARCHED", 0)
    other = {(r.origin, r.id): r.mass for r in walks.propagate(rows, origins, 1e-9, 12).collect()}
    assert one == {k: pytest.approx(m) for k, m in other.items()}


def test_gateway_keeps_a_path_a_work(spark):
    """A chain and a fork: rows grow with the paths on which all depend and not with all pairs."""
    pairs = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)] + [("c12", "d1"), ("c12", "d2"), ("d1", "e"), ("d2", "e")]
    lineage = spark.createDataFrame([("c00", a, b) for a, b in pairs], "origin string, source string, target string")
    lost = {r.id: r.score for r in walks.gateway(lineage, lineage.select("origin").distinct()).collect()}
    assert lost == {f"c{i:02d}": 15.0 - i for i in range(1, 13)} | {"d1": 0.0, "d2": 0.0, "e": 0.0}


def test_recovered_titles_make_no_pairs(spark):
    """400 works and 400 references of one title, in many years: a row a year of a title, not a row a pair."""
    nodes = [(f"W{i}", "Same title", 1900 + i % 40) for i in range(400)] + [("W900", "Same title", 1950), ("W901", "same-title!", None), ("W902", "Alone", None), ("W903", "", 2000)]
    refs = [(f"S{i}", None, "same title.", 1900 + i % 40) for i in range(400)] + [("S900", None, "Alone", 1990), ("S901", None, "alone", None), ("S902", "7", "Alone", None), ("W902", None, "alone", None), ("S903", None, "", 2000)]
    works = spark.createDataFrame(nodes, "id string, title string, year int")
    told = recover.recovered(works, spark.createDataFrame(refs, "source string, ref_id string, ref_title string, ref_year int"))
    assert {tuple(r) for r in told.collect()} == {("S900", "W902"), ("S901", "W902"), ("S902", "W7")}
    assert most_rows(told) < 2000
    dated = spark.createDataFrame([r for r in nodes if r[0] != "W901"], "id string, title string, year int")
    told = recover.recovered(dated, spark.createDataFrame([(f"S{i}", None, "same title", 1951) for i in range(300)], "source string, ref_id string, ref_title string, ref_year int"))
    assert {tuple(r) for r in told.collect()} == {(f"S{i}", "W900") for i in range(300)}


def test_pairs_are_scored_by_blocks(spark, monkeypatch):
    rng = random.Random(4)
    nodes = [("c", "node", f"n{i:02d}", None, [i / 40, 1.0, rng.random(), rng.random(), 0.7], None, None) for i in range(40)]
    pairs = [("c", kind, f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}", None, split, k % 2) for k in range(200) for kind, split in ((("message", None) if k % 3 else ("pair", ("train", "test")[k % 2])),)]
    rows = spark.createDataFrame(nodes + pairs, "cut string, kind string, a string, b string, x array<double>, split string, label int")
    told = []
    for most in (models.PAIRS, 5):
        monkeypatch.setattr(models, "PAIRS", most)
        out = models.trained(rows, epochs=3)
        told.append(sorted((r.source, r.target, r.split, r.label, round(r.logit, 9)) for r in out.collect()))
    assert told[0] == told[1] and len(told[0]) == sum(p[1] == "pair" for p in pairs)


def test_vectors_of_some_works_alone(spark):
    """They count all works, but only their own words are dealt out to be weighed."""
    nodes = [("a", "Graph graph theory", "walks on walks"), ("b", "Graph", None), ("c", "", ""), ("d", None, "zeta graph the"), ("e", "walks", "again")]
    table = spark.createDataFrame(nodes, "id string, title string, abstract string")
    every = {(r.id, r.word): round(r.weight, 9) for r in content.tfidf(table).collect()}
    some = {(r.id, r.word): round(r.weight, 9) for r in content.tfidf(table, only=table.where("id = 'a'")).collect()}
    assert some and some == {k: w for k, w in every.items() if k[0] == "a"}


def test_inverted_index_stays_in_its_row(spark, tmp_path):
    texts = ["a b a", "", None, "one", "b  b ", "a b a"]
    rows = spark.createDataFrame([(k % 5, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.inverted_index_roundtrip(spark, str(tmp_path))
    assert sorted((r.doc_id, r.abstract or "") for r in out.collect()) == sorted((k % 5, t or "") for k, t in enumerate(texts))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
