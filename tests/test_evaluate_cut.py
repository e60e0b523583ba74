from ancestra.plans import catalog


def test_both_samplers_and_four_scorers_rank_among_100(spark, sf, monkeypatch):
    frame = catalog._grid(spark, sf)
    monkeypatch.setattr(catalog, "_grid", lambda *_: frame)
    got = {(r.sampler, r.scorer): r for r in catalog.evaluate_cut(spark, sf).collect()}
    assert set(got) == {(s, k) for s in ("uniform", "year_matched") for k in ("recency", "in_degree", "logistic", "model")}

    rows = frame.toPandas()
    positives = rows[rows.label == 1].groupby(["sampler", "scorer"]).size()
    assert positives.nunique() == 1
    assert rows.candidate.max() == 100
    rivals = rows[rows.label == 0].groupby(["sampler", "scorer", "source", "cited"]).size()
    assert rivals.loc["uniform"].min() >= 95

    for key, part in rows.groupby(["sampler", "scorer"]):
        ranks = []
        for _, pool in part.groupby(["source", "cited"]):
            own, other = pool[pool.label == 1].score.iloc[0], pool[pool.label == 0].score
            if len(other):
                ranks.append(1 + (other > own).sum() + (other == own).sum() / 2)
        assert abs(sum(1 / r for r in ranks) / len(ranks) - got[key].mrr) < 1e-9
        assert abs(sum(r <= 10 for r in ranks) / len(ranks) - got[key].hits_at_10) < 1e-9
    assert all(got["uniform", k].hits_at_10 < 1 for k in ("recency", "in_degree"))
