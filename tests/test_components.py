from ancestra.plans import catalog
from ancestra.plans import fixtures as fx


def test_weak_components_are_of_all_citations(spark, sf):
    ids = [r.id for r in fx.works(spark, sf).select("id").collect()]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in fx.citations(spark, sf).select("source", "target").collect():
        a, b = sorted((find(r.source), find(r.target)))
        root[b] = a
    got = {r.id: r.label for r in catalog.QUERIES["weak_components"](spark, sf).collect()}
    assert got == {i: find(i) for i in ids}
