import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


SENTENCES = [
    ["The gate stood open.", "Nobody came!", "Why not?"],
    ["Compare plate no. 14 with eq. 9.", "Both agree."],
    ["K. L. Moreau paints boats.", "She sells few."],
    ["Gauge 7. 5 turns were left.", "Done."],
    ["“Leave it.”", "They left."],
    ["(It was noon.)", "Later it rained."],
    ["a line without an end"],
    ["it stops. but goes on in small letters"],
    ["Send it to Acme Inc. or to Bolt Ltd. today.", "[4] is a note no more."],
    [],
]


@pytest.mark.parametrize("wanted", SENTENCES)
def test_sentences_come_apart_where_they_were_joined(spark, wanted):
    joined = [s for s in wanted if not s.startswith("[")]
    assert value(spark, T.sentences(F.lit(" ".join(joined)))) == joined


@pytest.mark.parametrize("word", T.SENTENCE_ABBREVIATIONS)
def test_abbreviations_end_no_sentence(spark, word):
    assert value(spark, T.sentences(F.lit(f"Seen at {word}. Harbour by night. Then gone."))) == [f"Seen at {word}. Harbour by night.", "Then gone."]


PLAIN = ["stone.", "élan", "don't", "tide,"]
SPOKEN = {
    "valves[11–12];": ["valves;"], "plan[7]": ["plan"], "[8,9]": [], "7.5%!": ["7.5", "percent!"], "◦": [], "(cf.": ["compare"], "Sec.,": ["section"], "www.tide.example/q": ["a link"],
    "crew@tide.example": ["an email address"], "red—blue": ["red,", "blue"], "m³": ["m"], "u<v": ["u", "less", "than", "v"], "B&B": ["B", "and", "B"], "§": ["section"], "%]": ["percent]"],
}


@pytest.mark.parametrize(("token", "spoken"), [*SPOKEN.items(), *[(w, [w]) for w in PLAIN], *[(k, v.split(" ")) for k, v in T.SPOKEN_ABBREVIATIONS.items()]])
def test_speak_token(spark, token, spoken):
    assert value(spark, T.speak_token(F.lit(token))) == spoken


def test_every_spoken_word_points_at_its_token(spark):
    said = value(spark, T.to_speech(F.lit("Mix 3 + 4 cups & stir [9], then rest.")))
    assert said["text"] == "Mix 3 plus 4 cups and stir, then rest."
    assert [w["token"] for w in said["words"]] == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert [said["text"][w["offset"] :].split(" ")[0] for w in said["words"]] == said["text"].split(" ")


def test_token_index_of_each_character(spark):
    text = "Nine grey herons wait"
    found = [r[0] for r in spark.range(-1, 40).orderBy("id").select(T.token_index_at(F.lit(text), F.col("id").cast("int"))).collect()]
    assert found == [0] + [text[: i + 1].strip().count(" ") for i in range(40)]


@pytest.mark.parametrize(
    ("base", "href", "path"),
    [("a/b.opf", "c.x#p", "a/c.x"), ("a/b.opf", "../c.x", "c.x"), ("b.opf", "#p", "b.opf"), ("a/b.opf", "/r.x", "r.x"), ("a/b.opf", "../../../c", "c"), ("b.opf", "a//./c", "a/c")],
)
def test_resolve_path(spark, base, href, path):
    assert value(spark, T.resolve_path(F.lit(base), F.lit(href))) == path


def test_labels(spark):
    row = spark.range(1).select(
        T.clock(F.lit(3725.4)).alias("a"), T.clock(F.lit(-3.0)).alias("b"), T.clock(F.lit(59.6)).alias("c"), T.time_left(F.lit(20.0)).alias("d"), T.time_left(F.lit(3600.0)).alias("e"),
        T.time_left(F.lit(5460.0)).alias("f"), T.rate_label(F.lit(1.0)).alias("g"), T.rate_label(F.lit(1.25)).alias("h"), T.rate_label(F.lit(0.5)).alias("i"), T.clock(F.lit(float("nan"))).alias("j"),
    ).first()
    assert list(row) == ["1:02:05", "0:00", "1:00", "1 min left", "1 hr left", "1 hr 31 mins left", "1", "1.25", "0.5", "0:00"]


def test_titles_and_authors(spark):
    kinds = ["docx", "doc", "PDF", "epub", "indd", "tex", "pages", "odt"]
    junk = [f"rota.{k}" for k in kinds] + ["UNTITLED", "unknown", "Document77", "PDF document", "Microsoft Word", "microsoft word- x", " ", "q"]
    good = ["Low Water", "Untitled sketches", "Documents", "The pdf", "rota.pdf.zip", "qq"]
    rows = spark.createDataFrame([(f" {t}\n",) for t in junk + good], "t string").select(T.usable_title(F.col("t"))).collect()
    assert [r[0] for r in rows] == [None] * len(junk) + good
    nobody, somebody = ["ANONYMOUS", "user", "Owner", " "], ["Ann User", "x", "Owners"]
    rows = spark.createDataFrame([(f"\t{a} ",) for a in nobody + somebody], "t string").select(T.usable_author(F.col("t"))).collect()
    assert [r[0] for r in rows] == [None] * len(nobody) + somebody


def test_a_text_is_cut_only_where_a_sentence_may_open(spark):
    made = spark.createDataFrame([('He said (no.) twice. "Yes." she said. Then Mr. Ox left at 3.5. 4 came.',)], "t string").select(T.sentences(F.col("t")).alias("s"))
    assert made.first()["s"] == ['He said (no.) twice.', '"Yes." she said.', "Then Mr. Ox left at 3.5. 4 came."]
    # the pattern begins with the space, and the words are bound: each is taken from its part once
    shown = made._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("substring_index(") == 2 and "split(t#" in shown
