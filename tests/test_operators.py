"""Small graphs with answers known in closed form, and what the catalog does not reach."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ancestra.functions import text
from ancestra.operators import clean, joins, metrics, models, narrative, walks
from ancestra.sources import journal, snapshots, works
from ancestra.streaming import journal as stream


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "source string, target string")


def lineage(spark, pairs, origin):
    reached = walks.reach(edges(spark, pairs), spark.createDataFrame([(origin,)], "origin string"))
    return walks.ancestry(edges(spark, pairs), reached), reached


def scores(df):
    return {r.id: pytest.approx(r.score) for r in df.collect()}


def drawn(seed, n, share, back=0):
    """Works w00 .. of a drawn graph: each cites a share of the older ones, and so many cite newer ones."""
    rng = np.random.default_rng(seed)
    pairs = {(f"w{i:02d}", f"w{j:02d}") for i in range(n) for j in range(i) if rng.random() < share or j == i - 1}
    while back:
        i, j = sorted(rng.integers(0, n, 2))
        back -= i < j
        pairs |= {(f"w{i:02d}", f"w{j:02d}")} if i < j else set()
    return sorted(pairs)


def reachable(pairs, start, without=None):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        new = {b for a, b in pairs if a == at and b != without} - seen
        seen |= new
        todo += new
    return seen


def test_scores_against_brute_force(spark):
    pairs, origin = drawn(11, 13, 0.25), "w12"
    line, reached = lineage(spark, pairs, origin)
    held = reachable(pairs, origin)
    assert {r.id for r in reached.collect()} == held
    inner = [(a, b) for a, b in pairs if a in held]
    assert {(r.source, r.target) for r in line.collect()} == set(inner)
    others = sorted(held - {origin})
    assert scores(walks.in_degree(line, reached)) == {x: sum(b == x for _, b in inner) for x in others}
    assert scores(walks.gateway(line, reached.select("origin").distinct())) == {x: len(held) - 1 - len(reachable(inner, origin, x)) for x in others}
    mass, moved = {origin: 1.0}, {origin: 1.0}
    for x in sorted(held, reverse=True):  # a work is numbered above all that it cites
        cited = [b for a, b in inner if a == x]
        for b in cited:
            mass[b] = mass.get(b, 0) + mass[x] / 2
            moved[b] = moved.get(b, 0) + moved[x] * 0.85 / len(cited)
    assert scores(walks.path_weight(line, reached)) == {x: mass[x] for x in others}
    years = spark.createDataFrame([(x, 2000 + int(x[1:])) for x in sorted(held)], "id string, year int")
    assert scores(walks.flow(line, reached, years)) == {x: moved[x] * 0.5 ** ((12 - int(x[1:])) / 10) for x in others}
    shown = [origin, *others[::3]]
    links = walks.skeleton(line, spark.createDataFrame([(origin, x) for x in shown], "origin string, id string")).collect()
    below = {x: reachable(inner, x) - {x} for x in shown}
    plain = {(a, b) for a in shown for b in shown if b in below[a] and not any(c in below[a] and b in below[c] for c in shown if c not in (a, b))}
    assert {(r.citing, r.cited) for r in links} == plain
    assert all(r.direct == ((r.citing, r.cited) in inner) for r in links)


def test_knots_are_untied(spark):
    pairs, origin = drawn(5, 12, 0.2, back=4), "w11"
    line, _ = lineage(spark, pairs, origin)
    inner = {(r.source, r.target) for r in line.collect()}
    years = spark.createDataFrame([(f"w{k:02d}", None if k == 4 else 1990 + k // 3) for k in range(12)], "id string, year int")
    kept = {(r.source, r.target) for r in walks.acyclic(line, years).collect()}
    assert kept < inner
    assert not any(a in reachable(sorted(kept), b) for a, b in kept)
    tied = {(a, b) for a, b in inner if a in reachable(sorted(inner), b)}
    assert inner - kept <= tied
    year = {r.id: r.year or 0 for r in years.collect()}
    assert all(year[a] >= year[b] for a, b in kept & tied)


def test_pagerank_is_the_settled_one(spark):
    pairs, origin = drawn(7, 12, 0.2, back=5), "w11"
    line, reached = lineage(spark, pairs, origin)
    ids = sorted(r.id for r in reached.collect())
    at = {x: k for k, x in enumerate(ids)}
    step = np.zeros((len(ids), len(ids)))
    for r in line.collect():
        step[at[r.target], at[r.source]] = 1
    loose = step.sum(0) == 0
    step = step / np.maximum(step.sum(0), 1)
    start = np.eye(len(ids))[at[origin]]
    rank = start
    for _ in range(400):
        rank = 0.85 * (step @ rank + rank[loose].sum() * start) + 0.15 * start
    got = {r.id: r.score for r in walks.pagerank(line, reached).collect()}
    assert got == {x: pytest.approx(rank[at[x]], abs=1e-8) for x in ids if x != origin}


def test_components_with_a_centre(spark, monkeypatch):
    pairs = [("c", f"x{k}") for k in range(40)] + [("y1", "y2"), ("y2", "y3"), ("z", "x7")]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} | {"alone"})], "id string")
    for most in (joins.ROWS, 5):
        monkeypatch.setattr(joins, "ROWS", most)
        got = {r.id: r.label for r in walks.components(edges(spark, pairs), nodes).collect()}
        assert got == {r.id: "y1" if r.id[0] == "y" else "alone" if r.id == "alone" else "c" for r in nodes.collect()}


def test_display_names(spark):
    told = [("Noether, Emmy 1882-1935", "Emmy Noether"), ("Grace Hopper", "Grace Hopper"), ("One, Two, Three", "One, Two, Three"), ("Hypatia,", "Hypatia"), ("田, 中", "田 中"), ("Çelik, Ayşe 1971-", "Ayşe Çelik")]
    rows = spark.createDataFrame(told, "name string, shown string")
    assert rows.where(~text.display_name(F.col("name")).eqNullSafe(F.col("shown"))).count() == 0


def test_first_authors(spark):
    rows = spark.createDataFrame([(["Ada Byron", "B"],), (["Zoë Ångström-Íñiguez"],), (["田 中"],), ([],), (None,)], "authors array<string>")
    assert [r.k for r in rows.select(text.first_author_key(F.col("authors")).alias("k")).collect()] == ["byron", "iniguez", "田中", "", ""]


def test_quoted_text_cannot_close_its_tag(spark):
    row = spark.createDataFrame([('W1</source>', 'a "b"\n<x></source>', "body </source> end")], "id string, title string, body string")
    told = row.select(text.quoted(F.col("id"), F.col("title"), F.lit("2000"), F.col("body")).alias("q")).first().q
    assert told.count("</source>") == 1
    assert told.count("<") == 2


def test_late_dates(spark):
    nodes = spark.createDataFrame([("A", 2017), ("B", 2019), ("C", 2025)], "id string, year int")
    out = clean.redated(nodes, edges(spark, [("A", "C"), ("B", "C")]))
    assert {r.id: r.year for r in out.collect()} == {"A": 2017, "B": 2019, "C": 2017}


def test_undated_works_need_open_bounds(spark):
    nodes = spark.createDataFrame([("A", None), ("B", 2000)], "id string, year int")
    assert clean.in_range(nodes, None, None).count() == 2
    assert clean.in_range(nodes, 1990, None).count() == 1


def test_metrics(spark):
    tied = spark.createDataFrame([("s", 2.0, 1, "a"), ("s", 1.0, 0, "b"), ("s", 1.0, 1, "c"), ("s", 0.0, 0, "d")], "scorer string, score double, label int, id string")
    assert metrics.roc_auc(tied, ["scorer"]).first().auc == pytest.approx(0.875)
    assert metrics.roc_auc(tied.withColumn("score", F.lit(1.0)), ["scorer"]).first().auc == pytest.approx(0.5)
    assert metrics.roc_auc(tied.where("label = 1"), ["scorer"]).first().auc is None
    positives = spark.createDataFrame([("s", "p", 3.0), ("s", "q", 1.0)], "scorer string, owner string, score double")
    others = spark.createDataFrame([("s", "p", 4.0), ("s", "p", 2.0), ("s", "p", 3.0), ("s", "q", 0.0), ("s", "q", 1.0)], "scorer string, owner string, score double")
    assert {r.owner: r.rank for r in metrics.positive_ranks(positives, others, ["scorer"]).collect()} == {"p": 2.5, "q": 1.5}
    ranking = spark.createDataFrame([("T", "X", 1), ("T", "A", 2), ("T", "Y", 3)], "origin string, id string, place int")
    gold = spark.createDataFrame([("T", 0, ["A", "A2"]), ("T", 1, ["B"])], "origin string, work int, ids array<string>")
    got = metrics.recall_ndcg(ranking, gold, 3).first()
    gain = 1 / np.log2(3)
    assert (got.recall, got.ndcg) == (0.5, pytest.approx(gain / (1 + gain)))


def test_narrative_rejects_and_ends(spark):
    nodes = spark.createDataFrame([("T", "t", 2000, "x" * 600), ("A", "a", 1990, "y" * 600), ("B", "b", 1980, "short"), ("C", "c", 1970, None)], "id string, title string, year int, abstract string")
    told = spark.createDataFrame([("T", "A", 3.0), ("T", "B", 2.0), ("T", "C", 1.0)], "origin string, id string, score double")
    row = narrative.narrate(told, nodes, narrative.scripted_draft, narrative.scripted_judge).first()
    assert (row.claims, row.rejected, row.partial, row.attempts) == (["A"], 1, True, 2)


def journal_rows(spark, rows):
    return spark.createDataFrame([(i, t, None, 2000, None, [], refs, k) for k, (i, t, refs) in enumerate(rows)], journal.NODES)


def test_journal_and_stream(spark, tmp_path):
    folder = str(tmp_path / "journal")
    journal.append(journal_rows(spark, [("A", "first", ["B", "C"]), ("A", "second", ["B"])]), folder)
    assert journal.visited(spark, folder).count() == 1
    assert journal.edges(spark, folder).count() == 3
    journal.to_tables(spark, folder)
    assert [r.title for r in spark.read.parquet(f"{folder}/nodes.parquet").collect()] == ["first"]
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    stream.merge_into(spark, folder, table, checkpoint).awaitTermination()
    journal.append(journal_rows(spark, [("B", "b", ["C"]), ("A", "again", ["C"])]), folder)
    stream.merge_into(spark, folder, table, checkpoint).awaitTermination()
    got = sorted((r.source, r.target) for r in spark.read.parquet(table).collect())
    assert got == [("A", "B"), ("A", "C"), ("B", "C")]
    journal.save_state(folder, {"depth": 2})
    assert journal.load_state(folder) == {"depth": 2}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshots.latest(spark, root)
    nodes, cites = spark.range(3).toDF("id"), edges(spark, [("a", "b")])
    for date in ("2024-05-01", "2024-11-30"):
        snapshots.write(nodes, cites, nodes.limit(1), root, date)
    assert snapshots.latest(spark, root).endswith("2024-11-30")
    assert snapshots.read(spark, snapshots.latest(spark, root))[0].count() == 3


def test_work_records(spark):
    payload = [("https://x/W1", None, "Title", 2000, None, 3, ["https://x/W2"], {"b": [1], "a": [0, 2]}, ("https://x/T9",), [(("Ann",),), ((None,),)])]
    flat = works.flat(spark.createDataFrame(payload, works.PAYLOAD))
    row = flat.first()
    assert (row.id, row.title, row.abstract, row.topic_id, row.authors, row.referenced_works) == ("W1", "Title", "a b a", "T9", ["Ann"], ["W2"])
    assert works.citing(flat, "W2", topic="T9", start=1999).count() == 1
    assert works.citing(flat, "W2", end=1999).count() == 0


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    x, message = rng.normal(size=(8, 5)), rng.integers(0, 8, (2, 20))
    pairs, labels = rng.integers(0, 8, (2, 12)), rng.integers(0, 2, 12).astype(float)
    model = models.LinkPredictor(1, (5, 6, 4))
    _, grads = model.gradient(x, message, pairs, labels)
    for w, g in zip(model.weights, grads):
        at = tuple(int(rng.integers(0, n)) for n in w.shape)
        kept = w[at]
        w[at] = kept + 1e-6
        up, _ = model.gradient(x, message, pairs, labels)
        w[at] = kept - 1e-6
        down, _ = model.gradient(x, message, pairs, labels)
        w[at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_training_learns_preferential_links(spark):
    rng = np.random.default_rng(2)
    rows, degree, ends = [], np.ones(120), []
    for i in range(4, 120):
        for j in rng.choice(i, 3, replace=False, p=degree[:i] / degree[:i].sum()):
            ends.append((i, int(j)))
            degree[j] += 4
    counted = np.bincount([b for _, b in ends], minlength=120)
    for i in range(120):
        rows.append(("c", "node", str(i).zfill(3), None, [i / 120, 1.0, float(np.log1p(counted[i])), 1.1, 0.7], None, None))
    for k, (a, b) in enumerate(ends):
        split = "train" if k % 5 else "test"
        if split == "train":
            rows.append(("c", "message", str(a).zfill(3), str(b).zfill(3), None, None, None))
        rows.append(("c", "pair", str(a).zfill(3), str(b).zfill(3), None, split, 1))
        rows.append(("c", "pair", str(a).zfill(3), str(int(rng.integers(0, a))).zfill(3), None, split, 0))
    table = spark.createDataFrame(rows, "cut string, kind string, a string, b string, x array<double>, split string, label int")
    out = models.trained(table, epochs=60).where("split = 'test'").select(F.lit("m").alias("scorer"), F.col("logit").alias("score"), "label")
    assert metrics.roc_auc(out, ["scorer"]).first().auc > 0.6


def test_logistic_baseline(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"gap": rng.normal(size=400), "log_in": rng.normal(size=400)})
    rows["label"] = (rows.log_in - rows.gap + rng.normal(size=400) > 0).astype(int)
    model = models.logistic(spark.createDataFrame(rows))
    weights = model.stages[-1].coefficients
    assert weights[0] < 0 < weights[1]
