"""Stems, searches over columns and over an index."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents, search

#: Words of the published vocabulary of the stemmer, with their stems.
STEMS = (
    "consign consign consigned consign consignment consign consistency consist consistently consist consolatory consolatori consolidated consolid consonant conson conspicuously conspicu conspirators conspir "
    "constables constabl constancy constanc knackeries knackeri knaves knave kneaded knead kneeling kneel knightly knight knitting knit knives knive knocker knocker generate generat generously generous "
    "communism communism skies sky dying die hopping hop hoping hope falling fall happy happi enjoyed enjoy relational relat conditional condit rational ration electricity electr hopefulness hope possibly possibl "
    "geology geolog news news inning inning proceed proceed ties tie cries cri gas gas this this kiwis kiwi bead bead agreed agre as as"
).split()


def test_stems():
    assert [search.english_stem(w) for w in STEMS[::2]] == STEMS[1::2]


ROWS = [
    (1, "State the laws of motion, as they are taught.", "Physics"), (2, "A moving body obeys a law.", "Motion and rest"), (3, "Define the law of gravitational motion", "Gravity"), (4, "100% of batteries", "Chemistry"),
    (5, None, "Laws"), (6, "the of and", None), (7, "Motion of laws", "Physics"), (8, "law, motion; LAWS OF THE MOTIONS", None),
]
FINDS = {
    "law": {1, 2, 3, 5, 7, 8}, "motions laws": {1, 2, 3, 7, 8}, '"laws of motion"': {1}, '"law motion"': {2, 8}, "motion -physics": {2, 3, 8}, "gravity or battery": {3, 4}, 'law -"laws of motion" -motion': {5}, "moving motion": {2},
    "unknown": set(), '"define the law" or chemistry': {3, 4},
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, question string, chapter string")


@pytest.mark.parametrize("query", FINDS)
def test_searches(rows, query):
    assert {r.id for r in search.full_text(rows, ["question", "chapter"], query, []).collect()} == FINDS[query]


def test_plain_searches(rows):
    find = lambda q, **k: {r.id for r in search.full_text(rows, ["question", "chapter"], q, **k).collect()}
    assert find("100%") == {4} and find("F MOT") == {1} and find("the") == {1, 3, 6, 8} and find(" ") == set(range(1, 9))
    assert find("hem", plain=["chapter"]) == {4} and search.full_text(rows, ["question"], "law").columns == rows.columns


def test_index(spark, rows):
    index = search.token_index(rows, "id", {"question": "A", "chapter": "B"})
    for query, want in FINDS.items():
        assert {r.id for r in search.indexed(index, "id", query).collect()} == want, query
    hits = {r.id: (r.hits, r.heavy) for r in search.indexed(index, "id", "motion").collect()}
    assert hits[2] == (1, 0) and hits[8] == (2, 2)
    assert search.indexed(index, "id", "the").collect() == []
    with pytest.raises(ValueError):
        search.indexed(index, "id", "-law")


def test_a_search_makes_its_index_once(spark, rows):
    index = search.token_index(rows, "id", {"question": "A", "chapter": "B"})
    plan = search.indexed(index, "id", 'law or motion or "laws of motion"')._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan


def test_names_that_contain(spark):
    names = spark.createDataFrame([("organic chemistry",), ("chem",), ("math",), ("",), (None,)], "n string")
    parts = spark.createDataFrame([("chem",), ("a",), ("math",), ("",), (None,), ("organic chemistry lab",)], "p string")
    assert {tuple(r) for r in documents.containing(names, parts, "n", "p").collect()} == {("organic chemistry", "chem"), ("organic chemistry", "a"), ("chem", "chem"), ("math", "math"), ("math", "a")}
    assert documents.containing(names, parts.where(F.lit(False)), "n", "p").collect() == []
