"""Prompts, tenants, embedding and page ingestion on hand-made cases."""

from pyspark.sql import functions as F

from weftline.functions import prompts, urls
from weftline.operators import listing as L
from weftline.operators import pages, tenants
from weftline.operators import settings as S
from weftline.plans.tenant_queries import lengths
from weftline.streaming import ingest
from weftline.streaming.usage import read_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_prompt_sections_and_defaults(spark):
    p = one(spark, prompts.answer_prompt(F.lit(" why? "), F.lit(" \n"), F.lit("odd")))
    assert p.startswith("<role>\nYou are a friendly") and p.endswith("</instructions>\n\nAnswer:")
    assert f"<context>\n{prompts.NO_CONTEXT}\n</context>" in p and "<question>\nwhy?\n</question>" in p
    assert p.count(prompts.MANDATORY) == 1 and prompts.BY_MODE["fallback"] in p and "Fallback behavior: helpful." in p
    plain = prompts.Settings(infer=F.lit(False), strict=F.lit(False), identity=F.lit(False), constraints=F.array(F.lit("Always answer yes"), F.lit("Short")))
    p = one(spark, prompts.answer_prompt(F.lit(None).cast("string"), F.lit("c"), F.lit("complete"), plain))
    assert prompts.INFER not in p and prompts.GROUND not in p and prompts.AS_BRAND in p and "Always answer yes" not in p and "- Short" in p
    assert prompts.RECOVERY_INFER not in one(spark, prompts.recovery_prompt(F.lit("q"), F.lit("c"), F.lit("guided"), plain))


def test_fallback_and_better_answer(spark):
    assert one(spark, prompts.fallback_answer()).startswith("We couldn't find a clear answer on the website, but we can help with")
    said = one(spark, prompts.fallback_answer(prompts.Settings(fallback=F.lit("Be CONCISE"), identity=F.lit(False))))
    assert said.startswith("I couldn't find a clear answer on the website, but I can share")
    better = lambda a, b: one(spark, prompts.better_answer(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert better("I cannot answer this at all", "Yes") == "Yes" and better("Yes, it is", "No") == "Yes, it is"
    assert better("Yes", "Yes, it is") == "Yes, it is" and better("Yes", None) == "Yes" and better(None, "x") == "x"


def test_names(spark):
    assert one(spark, urls.gateway_url(F.lit("no url "))) == "no url"
    assert one(spark, urls.gateway_url(F.lit("http://www.A.org:80//"))) == "http://a.org/"
    assert one(spark, urls.gateway_url(F.lit("http://a.org"))) == "http://a.org/"
    assert one(spark, urls.folder_name(F.lit(None).cast("string"))) == "site" and one(spark, urls.folder_name(F.lit("..My.Site..com"))) == "my-site-com"
    assert one(spark, urls.domain_names(F.lit(None).cast("array<string>"))) == []
    assert one(spark, urls.domain_names(F.array(F.lit("A.org:1/x"), F.lit("https://www.a.org")))) == ["a.org"]


def test_tenant_operators(spark):
    objects = spark.createDataFrame([(1, "a", "ready"), (2, "b", None), (3, None, "paused")], "id long, client_id string, status string")
    clients = spark.createDataFrame([("a", "disabled"), ("a", "disabled"), (None, "disabled")], "client_id string, status string")
    assert {r["id"]: r["status"] for r in tenants.disable_objects(objects, clients).collect()} == {1: "disabled", 2: None, 3: "paused"}
    assert sorted(r["id"] for r in tenants.cascade_delete({"o": objects}, clients)["o"].collect()) == [2, 3]
    assert tenants.in_scope(objects, " b ").count() == 1 and tenants.in_scope(objects, " ").count() == 3
    once = tenants.backfill_scope(objects, "main")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, tenants.backfill_scope(once, "main").collect()))
    events = spark.createDataFrame([(1, 5), (1, 7)], "id long, recorded_at long")
    assert {r["id"]: r["last_accessed"] for r in tenants.touch(objects, events, "id").collect()} == {1: 7, 2: None, 3: None}
    state = {r["id"]: (r["t"], r["a"]) for r in objects.select("id", tenants.searchable_together(F.col("status")).alias("t"), tenants.searchable_alone(F.col("status")).alias("a")).collect()}
    assert state == {1: (True, True), 2: (False, True), 3: (False, False)}
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (2, 1, 0.1), (2, 2, 0.2)], "query_id long, rank int, score double")
    assert {r["query_id"]: r["sorted"] for r in tenants.ranking_holds(hits).collect()} == {1: True, 2: False}


def test_embedding_is_of_unit_length(spark):
    df = spark.createDataFrame([(i, "x" * i if i % 3 else None) for i in range(70)], "id long, text string")
    got = tenants.embed(df, "text", lengths, batch_size=7).collect()
    assert len(got) == 70 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in got)
    assert {r["id"] for r in got} == set(range(70)) and got[0]["embedding"] == [0.0, 1.0]
    assert tenants.embed(df.limit(0), "text", lengths).count() == 0


def test_ingestion_goes_on_where_it_ended(spark, tmp_path):
    page = lambda i: (i, f"http://a.org/{i}", f"<html><body><main><h1>T{i}</h1><p>{' '.join(f'word{i}x{j}' for j in range(60))}</p></main></body></html>")
    schema, source, target = "page_id long, url string, html string", str(tmp_path / "pages.parquet"), str(tmp_path / "out")
    spark.createDataFrame([page(1), page(2)], schema).write.parquet(source)
    ingest.ingest(read_stream(spark, source), target, str(tmp_path / "state"))
    first = {r["source_file"] for r in ingest.index(spark, target).collect()}
    spark.createDataFrame([page(3)], schema).write.mode("append").parquet(source)
    ingest.ingest(read_stream(spark, source), target, str(tmp_path / "state"))
    rows = ingest.index(spark, target).collect()
    assert len(first) == 2 and len({r["source_file"] for r in rows}) == 3
    whole = pages.chunk_documents(pages.documents(spark.read.parquet(source)).withColumn("source_file", F.format_string("%012d", "page_id")))
    assert {r["chunk_id"] for r in whole.collect()} == {r["chunk_id"] for r in rows}


def test_settings_are_saved_reset_and_loaded(spark, tmp_path):
    path, defaults = str(tmp_path / "settings"), ("Aide", ["Be brief"])
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,)], "setting_id long")
    load = lambda: {r["setting_id"]: (r["role"], r["constraints"], r["last_modified_by"]) for r in S.load_prompts(spark, path, ids, defaults).collect()}
    assert load() == {i: (*defaults, None) for i in (1, 2, 3)}
    rows = [(1, " Guide ", ["Short", " short "]), (2, None, None)]
    S.save_prompts(spark.createDataFrame(rows, "setting_id long, role string, constraints array<string>"), path, defaults, "ann")
    assert load() == {1: ("Guide", ["Short"], "ann"), 2: (*defaults, "ann"), 3: (*defaults, None)}
    S.reset_prompts(ids.where("setting_id = 1"), path, defaults, "bob")
    assert load()[1] == (*defaults, "bob") and spark.read.parquet(path).count() == 3


def test_seed_urls_are_found_in_any_form(spark):
    registry = [(7, 2, "HTTPS://A.org/x/"), (8, 1, " a.org/x "), (9, 1, "https://a.org/x#y"), (1, 0, None), (2, 0, "  "), (3, 5, "https://b.org")]
    wanted = ["https://a.org/x/", "https://b.org/", "https://c.org", None]
    found = L.find_by_seed_url(spark.createDataFrame(registry, "context_id long, created_at long, seed_url string"), spark.createDataFrame([(w,) for w in wanted], "wanted_url string"))
    got = {r["wanted_url"]: r["context_id"] for r in found.collect()}
    assert got["https://a.org/x/"] in (8, 9) and got["https://b.org/"] == 3 and got["https://c.org"] is None and got[None] is None
