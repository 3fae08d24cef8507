from pyspark.sql import functions as F

from engram.functions import metrics, text


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr).first()[0]


def test_keywords_keep_order_and_drop_stop_words(spark):
    assert one(spark, text.keywords(F.lit("The Deploy pipeline must run deploy_checks; an API is up"))) == ["deploy", "pipeline", "run", "deploy_checks", "api"]


def test_trigger_keywords_by_source(spark):
    got = one(spark, text.trigger_keywords(F.lit("Rate limits"), F.lit("calls go through NGINX. later, some_thing and Redis wait")))
    assert got == ["rate", "limits", "nginx", "some_thing", "redis", "calls"]


def test_markdown_sections(spark):
    docs = spark.createDataFrame([(1, "# Title\nintro\n## One\nbody one\n## Empty\n\n## Two\n  body two  "), (2, "\n# late\nplain"), (3, ""), (4, None), (5, "## \n# inner\nx")], "id int, content string")
    got = {(r["id"], r["section"]): (r["heading"], r["body"]) for r in text.markdown_sections(docs, "id", "content").collect()}
    assert got == {(1, 0): ("Title", "intro"), (1, 1): ("One", "body one"), (1, 2): ("Two", "body two"), (2, 0): ("", "# late\nplain"), (5, 0): ("inner", "x")}


def test_chats(spark):
    chat = "[user]: I like Kyoto trips\n[assistant]: fine\n[user]: book JAL"
    assert one(spark, text.is_chat(F.lit(chat))) and not one(spark, text.is_chat(F.lit("[user]: hi\nplain")))
    assert one(spark, text.chat_keywords(text.user_turns(F.lit(chat)))) == ["kyoto", "jal", "like", "trips"]


def test_answers(spark):
    assert one(spark, text.normalize_answer(F.lit("The Answer  is: 42!"))) == "answer is 42"
    assert one(spark, text.normalize_answer(F.lit("a an the théâtre anthem"))) == "théâtre anthem"
    assert one(spark, metrics.exact_match(F.lit("The cat"), F.array(F.lit("dog"), F.lit("cat!")))) == 1.0
    assert abs(one(spark, metrics.token_f1(F.lit("red red car"), F.lit("red car bus"))) - 2 / 3) < 1e-9
    assert one(spark, metrics.best_f1(F.lit(""), F.array(F.lit("x")))) == 0.0


def test_retrieval_metrics(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<int>")
    assert one(spark, metrics.recall_at(ids(1, 2, 3), ids(3, 9), 3)) == 0.5
    assert one(spark, metrics.recall_at(ids(1), ids(), 3)) == 1.0
    assert one(spark, metrics.precision_at(ids(), ids(1), 3)) == 0.0
    assert one(spark, metrics.support_f1(ids(), ids())) == 1.0
    assert one(spark, metrics.trigger_precision(ids(), ids(1))) == 1.0
    assert one(spark, metrics.trigger_precision(ids(1, 2), ids(1))) == 0.5
    assert one(spark, metrics.suppression(ids(), ids())) == 1.0
