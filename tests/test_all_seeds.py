from lorewright import catalog
from lorewright.sources import views

SF = "/root/testdata/sf0.001"


def test_every_entry_is_a_seed(spark):
    entries, edges = views.entries(spark, SF), views.edges(spark, SF)
    ids = {r.id for r in entries.select("id").collect()}
    active = {r.id for r in entries.where("status <> 'archived'").select("id").collect()}
    linked = {a for r in edges.collect() for a, b in ((r.source_id, r.target_id), (r.target_id, r.source_id)) if a in ids and b in active and a != b}
    assert {r.seed for r in catalog.queries()["related_depth_2"](spark, SF).collect()} == linked
    assert {r.id for r in catalog.queries()["authority_boost"](spark, SF).collect()} == ids
