"""Rules on words, held to what texts they are for."""

import pytest
from pyspark.sql import functions as F

from siltflow.functions import urls as U
from siltflow.operators import routing as Q


def ask(spark, rule, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", rule(F.col("t")).alias("x")).orderBy("i").collect()]


def test_gap_claims(spark):
    yes = ["Acme has no queue.", "Today Acme doesn't offer it", "acme's builder cannot", "There is no real acme equivalent", "No counterpart", "Acme (the product) lacks it", "Acme, as far as we know, is missing it"]
    no = ["Acme can. It does not rain.", "Others lack acme", "acme" + " word" * 40 + " lacks it", "no " + "long " * 12 + "parity", "Acmes lack it", "macme lacks", "acme relocks it", None, ""]
    assert ask(spark, lambda t: Q.claims_gap(t, "acme"), yes + no) == [True] * len(yes) + [False] * len(no)


def test_notes_instead_of_copy(spark):
    yes = ["Say that it is fast", "clarify: the price", "Note that it", "make sure it", "Make this clear", "Update the table", "add a bullet about it", "Include this note", "call out the limit", "Answer their claim", "consider"]
    no = ["Saying so", "Note it", "Make it", "make clear", "Update tables", "Add billing", "Added a line", "Calling out", "answer a claim", "It says", ""]
    assert ask(spark, lambda t: Q.opens(Q.opening(t), Q.NOTE), yes + no) == [True] * len(yes) + [False] * len(no)


def test_documents_alone(spark):
    yes = ["Document it.", "Write up the docs", "write docs", "Add a doc page", "Add documentation", "Publish the docs", "create doc", "Update the docs."]
    no = ["Update docs", "Write a blog", "Documents are fine", "Add a page", "Build it and document it"]
    assert ask(spark, Q.is_documentation_only, yes + no) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("name, generic", [("og-default.png", True), ("a/default_share.jpg", True), ("defaultseo.png", True), ("x.default-social2.png", True), ("mysocial.defaults.png", True), ("default.png", False), ("og.png", False), ("default--og.png", False), ("default/og.png", False), ("logo-default.png", False)])
def test_default_cards(spark, name, generic):
    assert ask(spark, U.is_generic_preview, [f"https://e.example/{name}"]) == [generic]
