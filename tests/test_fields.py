"""Settings, remote reading, whole-field builds, crawls, saved models and structured answers."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ancestra.operators import answers, crawl, fields, models, ranking
from ancestra.sources import remote, saved, settings, works


def settings_file(folder, name="ants", **more):
    told = {"name": name, "description": " about \n ants ", "seed_papers": ["W9", "W8"], "crawl": {"hop_depth": 1, "start": 1990}} | more
    (folder / f"{name}.json").write_text(json.dumps(told))
    return str(folder)


def test_settings(tmp_path):
    field = settings.load_field("ants", settings_file(tmp_path))
    assert (field.description, field.seed_papers, field.crawl.hop_depth, field.crawl.end) == ("about ants", ("W9", "W8"), 1, None)
    assert settings.load_field(str(tmp_path / "ants.json")) == field
    (tmp_path / "bees.yaml").write_text("name: bees\nseed_papers: [W1]\n")
    assert settings.load_field("bees", str(tmp_path)).crawl == settings.Crawl()
    with pytest.raises(FileNotFoundError):
        settings.load_field("wasps", str(tmp_path))


@pytest.mark.parametrize("more", [{"name": "other"}, {"seed_papers": []}, {"crawl": {"hop_depth": -1}}, {"crawl": {"forward_depth": 1}}, {"crawl": {"start": 2000, "end": 1990}}, {"colour": "red"}, {"crawl": {"max_nodes": 0}}])
def test_bad_settings(tmp_path, more):
    folder = settings_file(tmp_path)
    told = json.loads((tmp_path / "ants.json").read_text()) | more
    (tmp_path / "ants.json").write_text(json.dumps(told))
    with pytest.raises(settings.BadSettings):
        settings.load_field("ants", folder)


def test_gold(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps([{"target": "W9", "split": "dev", "originators": [["W1", "W2"], ["W3"]]}]))
    rows = settings.load_gold(spark, str(path)).orderBy("work").collect()
    assert [tuple(r) for r in rows] == [("W9", "dev", 0, ["W1", "W2"]), ("W9", "dev", 1, ["W3"])]
    for bad in ({"target": "W9", "split": "train", "originators": [["W1"]]}, {"target": "W9", "split": "dev", "originators": [[]]}):
        path.write_text(json.dumps([bad]))
        with pytest.raises(settings.BadSettings):
            settings.load_gold(spark, str(path))


def test_pages_end_without_cursor_or_items():
    book = {"*": ([1, 2], "a"), "a": ([3], "b"), "b": ([], "c")}
    assert list(remote.pages(book.__getitem__)) == [1, 2, 3]
    assert list(remote.pages({"*": ([1], None)}.__getitem__)) == [1]


def test_calls_pause_and_try_again():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 3))
        now[0] += seconds

    left = [remote.Failed(503), remote.Failed(429, {"Retry-After": "7"}), "answer"]

    def call():
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    caller = remote.Caller(pause=0.1, attempts=5, backoff=2.0, clock=lambda: now[0], sleep=sleep)
    assert caller(call) == "answer"
    assert slept == [2.0, 7.0]
    left[:] = ["next"]
    assert caller(call) == "next" and slept[-1] == 0.1
    left[:] = [remote.Failed(404)]
    with pytest.raises(remote.Failed):
        caller(call)
    left[:] = [remote.Failed(500)] * 9
    with pytest.raises(remote.Failed):
        caller(call)
    assert len(left) == 3


def test_second_catalogue(spark):
    told = dict(remote.asked([f"W{k}" for k in range(5)], lambda batch: [None if i == "W3" else {"id": i} for i in batch], size=2))
    assert set(told) == {"W0", "W1", "W2", "W4"}
    with pytest.raises(ValueError):
        list(remote.asked(["a"], lambda batch: []))
    rows = [("W1", [("A title", 2000, {"MAG": "7"}), None]), ("W2", None), ("W3", [(None, None, None)])]
    got = remote.references(spark.createDataFrame(rows, remote.REFERENCES), "MAG").collect()
    assert sorted(map(tuple, got), key=str) == [("W1", "A title", 2000, "7"), ("W3", None, None, None)]


def test_chunks(spark):
    rows = works.chunks(spark.range(1003).select(F.format_string("W%05d", "id").alias("id")).repartition(5), 50).collect()
    assert {r.id: r.chunk for r in rows} == {f"W{k:05d}": k // 50 for k in range(1003)}
    assert works.work(spark.createDataFrame([("a",), ("b",)], "id string"), "b").count() == 1


CITES = [(a, b) for a in range(1, 40) for b in (a // 2, a // 3) if b != a]


@pytest.fixture(scope="module")
def corpus(spark):
    nodes = spark.createDataFrame([(f"W{k}", 1960 + k, "t" if k % 2 else "u") for k in range(40)], "id string, year int, topic string")
    cites = spark.createDataFrame(sorted({(f"W{a}", f"W{b}") for a, b in CITES}), "source string, target string")
    return nodes, cites


def hops_of(seeds, hops, start):
    out, last = {}, set(seeds)
    for hop in range(hops + 1):
        new = {x for x in last if x not in out and 0 <= x < 40}
        out |= {x: hop for x in new}
        last = {b for a, b in CITES if a in new and 1960 + a >= start}
    return out


def test_crawl_stops_at_its_budget_and_goes_on(spark, corpus, tmp_path):
    nodes, cites = corpus
    seeds = spark.createDataFrame([("W39",), ("W34",), ("W99",)], "id string")
    want = hops_of([39, 34], 4, 1965)
    whole = crawl.snowball(nodes, cites, seeds, str(tmp_path / "whole"), hops=4, start=1965)
    assert {r.id: r.hop for r in whole.collect()} == {f"W{k}": h for k, h in want.items()}
    order = sorted(want, key=lambda k: (want[k], f"W{k}"))
    folder = str(tmp_path / "cut")
    for most in (1, 3, 6, 6):
        got = crawl.snowball(nodes, cites, seeds, folder, hops=4, start=1965, most=most)
        assert {r.id for r in got.collect()} == {f"W{k}" for k in order[:most]}
    rest = crawl.snowball(nodes, cites, seeds, folder, hops=4, start=1965)
    assert {r.id: r.hop for r in rest.collect()} == {f"W{k}": h for k, h in want.items()}


def test_crawl_forward_and_fill(spark, corpus, tmp_path):
    nodes, cites = corpus
    seeds = spark.createDataFrame([("W5",)], "id string")
    rows = crawl.snowball(nodes, cites, seeds, str(tmp_path / "f"), hops=0, forward_hops=2, least=2, topic="t", start=1960).collect()
    told = {(r.phase, r.hop): {int(x.id[1:]) for x in rows if (x.phase, x.hop) == (r.phase, r.hop)} for r in rows}
    one = {a for a, b in CITES if b == 5 and a % 2}
    two = {a for a, b in CITES if b in one and a % 2}
    assert told["backward", 0] == {5} and told["forward", 1] == one and told["forward", 2] == two - one - {5}
    held = {5} | one | two
    counts = {b: sum((a, b) in set(CITES) for a in held) for b in range(40)}
    assert told.get(("fill", 1), set()) == {b for b, n in counts.items() if n >= 2 and b not in held}


def test_field_build_and_library(spark, tmp_path):
    nodes = spark.createDataFrame([(f"W{k}", f"Title {k}", "text" if k % 3 else None, 1980 + k, ["A B"], k) for k in range(12)], "id string, title string, abstract string, year int, authors array<string>, ord long")
    cites = spark.createDataFrame([(f"W{k}", f"W{k - 1}") for k in range(1, 9)] + [("W10", "W11")], "source string, target string")
    (tmp_path / "fields").mkdir()
    folder = settings_file(tmp_path / "fields", seed_papers=["W2", "W3", "W40"], exclude=["W2"], titles={"W5": "Right"}, merge={"W8": "W7"}, crawl={"start": 1981})
    root = str(tmp_path / "data")
    library = fields.Library(spark, folder, root)
    assert library.health() == {"ants": False}
    with pytest.raises(fields.NotReady):
        library.state("ants")
    with pytest.raises(fields.Unknown):
        library.state("wasps")
    at, report = fields.build_field(spark, settings.load_field("ants", folder), nodes, cites, root, "2024-01-02")
    row = report.first()
    assert at.endswith("ants/2024-01-02") and row.dropped_seeds == ["W2", "W40"]
    assert (row.raw_nodes, row.excluded_nodes, row.merged_nodes, row.out_of_range_nodes, row.nodes, row.edges) == (12, 1, 1, 1, 5, 4)
    assert (row.graph_nodes, row.graph_edges) == (5, 4)
    state = library.state("ants")
    told = {r.id: (r.title, r.abstract) for r in state.nodes.collect()}
    assert set(told) == {"W3", "W4", "W5", "W6", "W7"}
    assert told["W5"] == ("Right", None) and told["W4"] == ("Title 4", "text") and told["W3"] == ("Title 3", None)
    assert library.state("ants") is state and library.health() == {"ants": True}
    assert library.summaries() == [{"name": "ants", "description": "about ants", "seeds": 3, "ready": True}]
    ask = lambda known: known.select(F.col("id").alias("source"), F.lit("title 3").alias("ref_title"), F.lit(1983).alias("ref_year"), F.lit(None).cast("string").alias("ref_id"))
    new = fields.recover_field(state.nodes, state.edges, ask, str(tmp_path / "second"))
    assert {(r.source, r.target) for r in new.collect()} == {("W5", "W3"), ("W6", "W3"), ("W7", "W3")}


def test_questions_are_checked():
    assert fields.resolved("W12", 5) == ("W12", 5)
    for bad in (("12", 5), ("W1x", 5), ("W1", 0), ("W1", 51)):
        with pytest.raises(ValueError):
            fields.resolved(*bad)
    assert fields.allowed_origins("https://a.example, https://b.example") == ["https://a.example", "https://b.example"]
    assert len(fields.allowed_origins(None)) == 1
    assert fields.checked_base_url("https://models.example/v1/") == "https://models.example/v1"
    assert fields.checked_base_url("http://127.0.0.1:8080") == "http://127.0.0.1:8080"
    for bad in ("http://models.example", "ftp://a.example", "file:///x", "https://", "https://me:pw@a.example"):
        with pytest.raises(ValueError):
            fields.checked_base_url(bad)
    keys = {"first": "FIRST_KEY", "second": "SECOND_KEY"}
    assert fields.chosen_backend({"MODEL": "second"}, keys, "MODEL", "here") == "second"
    assert fields.chosen_backend({"SECOND_KEY": "k"}, keys, "MODEL", "here") == "second"
    assert fields.chosen_backend({}, keys, "MODEL", "here") == "here"
    with pytest.raises(ValueError):
        fields.chosen_backend({"MODEL": "third"}, keys, "MODEL", "here")


def test_answers_get_one_repair(spark):
    form = StructType([StructField("name", StringType()), StructField("counts", ArrayType(LongType()))])
    prompts = spark.createDataFrame([(k, f"question {k}") for k in range(4)], "origin int, prompt string")
    calls = []

    def ask(told):
        rows = told.collect()
        calls.append({r.origin for r in rows})
        first = len(calls) == 1
        text = {0: '{"name": "a", "counts": [1, 2]}', 1: "no json" if first else '{"name": "b", "counts": []}', 2: '{"name": "c"}' if first else '{"name": "c", "counts": [3]}', 3: '{"name": "d", "counts": [null]}' if first else '{"name": "d", "counts": [4]}'}
        assert first or all("does not fit" in r.prompt for r in rows)
        return spark.createDataFrame([(r.origin, text[r.origin]) for r in rows], "origin int, text string")

    got = {r.origin: (r.answer.name, r.answer.counts) for r in answers.structured(prompts, form, ask).collect()}
    assert got == {0: ("a", [1, 2]), 1: ("b", []), 2: ("c", [3]), 3: ("d", [4])}
    assert calls == [{0, 1, 2, 3}, {1, 2, 3}]
    with pytest.raises(answers.Unfit):
        answers.structured(prompts, form, lambda told: told.select("origin", F.lit("never").alias("text")))


def test_schemas_are_tightened():
    loose = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {"type": "string"}}}}, "type": {"type": "string"}}, "$defs": {"x": {"type": "object"}}}
    tight = answers.strict_schema(loose)
    assert tight["required"] == ["a", "type"] and tight["additionalProperties"] is False
    assert tight["properties"]["a"]["items"] == {"type": "object", "properties": {"b": {"type": "string"}}, "additionalProperties": False, "required": ["b"]}
    assert tight["$defs"]["x"]["required"] == [] and "required" not in loose


def test_models_and_datasets_are_saved(spark, tmp_path):
    model = models.LinkPredictor(4)
    saved.save_model(spark, model, str(tmp_path / "model"), epochs=3)
    again, facts = saved.load_model(spark, str(tmp_path / "model"))
    assert facts == {"epochs": 3} and all((a == b).all() for a, b in zip(model.weights, again.weights))
    nodes, pairs = spark.createDataFrame([("a", 1.0)], "id string, x double"), spark.createDataFrame([("a", "b", "train", 1), ("a", "c", "test", 0)], "source string, target string, split string, label int")
    saved.save_dataset(str(tmp_path / "data"), nodes, pairs, pairs.select("source", "target"), nodes)
    loaded = saved.load_dataset(spark, str(tmp_path / "data"))
    assert loaded[1].where("split = 'test'").count() == 1 and loaded[0].count() == 1


def test_assessment(spark, corpus):
    nodes, cites = corpus
    gold = spark.createDataFrame([("W39", "dev", 0, ["W19", "W500"]), ("W39", "dev", 1, ["W38"]), ("W77", "test", 0, ["W1"])], "origin string, split string, work long, ids array<string>")
    even = lambda straight: straight.withColumn("weight", F.lit(1.0))
    rows = ranking.assess(cites, nodes.select("id", "year"), gold, [even, even], top=3, dropout=0.0)
    got = {r.scorer: r for r in rows.collect()}
    assert set(got) == {*ranking.BASELINES, "uniform_flow", "learned"}
    for r in got.values():
        assert (r.origin, r.originators, r.reachable, r.dropout_overlap, r.seed_overlap) == ("W39", 2, 1, 1.0, 1.0)
    assert got["learned"].found == 1 and got["learned"].recall == 1.0
    summary = ranking.split_summary(rows).where("scorer = 'learned'").first()
    assert (summary.split, summary.targets, summary.originators, summary.found) == ("dev", 1, 2, 1)
