from lexmill import schemas
from lexmill.sources.store import Store


def test_create_and_migrate(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    schemas.create(store)
    before = store.manifest()
    schemas.create(store)
    assert store.manifest() == before and set(before) == set(schemas.TABLES)
    articles = store.read("articles")
    assert "processing_flags" in articles.columns and schemas.migrate("articles", articles).columns == articles.columns
    assert store.read("session_state").first()["human_review_interval"] == 5
