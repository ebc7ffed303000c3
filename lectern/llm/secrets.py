"""Secret scans: fixed patterns, and a pair of character Markov models for strings that no pattern names.

DataFrame operations only. Candidate strings are scored by the log-likelihood ratio of two first-order character
models, one trained from labelled random strings, one from labelled ordinary identifiers; the ratio from which a
string counts as random is chosen on labelled samples that the models did not see.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, unused

# The patterns and shortest lengths of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "markov")

#: The alphabet of the strings that the models judge, its size and the shortest length judged.
ALLOWED, ALPHABET, LEAST = "[A-Za-z0-9+/_=-]", 67, 20
#: A span of a base kind, where candidates end.
BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"""
#: Base spans, and as group 1 the candidates: stretches of the alphabet outside them.
CANDIDATE = rf"(?:{BASE})|((?:(?!{BASE}){ALLOWED}){{{LEAST},}})"
#: Share of unseen ordinary strings that may count as random.
FALSE_ALARMS = 0.001

# Words of ordinary identifiers, from which the labelled samples are composed.
IDENTIFIER_WORDS = (
    "account action active address after array async average balance base batch before begin between block body buffer build byte cache call change channel "
    "character check child class client close code column command common compare complete component config connection container content context control copy count "
    "create current data database date default delete description destination detail device dialog direction directory disable display distance document domain "
    "element email empty enable encoding engine entry error event example exception execute export expression extension external feature field file filter final "
    "first folder font format forward frame function generate global graph group handler hash header height history image import index information initial input "
    "insert instance integer interface internal item iterator javascript keyboard label language layout length level library limit line link list listener loader "
    "local location logger machine manager mapping master matrix maximum memory message method minimum mobile model module monitor mouse multiple name network node "
    "normal notification number object offset operation option order original output package page panel parameter parent parser password path pattern payment "
    "performance permission person picture pixel platform player point pointer policy position prefix previous print priority private process product profile program "
    "project property protocol provider proxy public query queue random range reader record reference region register relative release remote remove render repeat "
    "replace report request require reserve resource response result return rotate schedule schema scope screen script scroll search second section select sequence "
    "server service session setting shadow shape share simple single size socket source space standard start state static status storage store stream string style "
    "subject submit summary support symbol system table target template temporary text thread time title token total track transaction transform translate transport "
    "trigger type unique unit update upload user utility value variable vector version vertical view visible volume weight widget width window worker wrapper write"
).split()


# Common words of German, French and Spanish, from which long ordinary words are composed.
COMMON_WORDS = (
    "arbeit aufgabe bedeutung beispiel bereich bestimmung beziehung dienst einheit entwicklung erfahrung ergebnis forschung freiheit gemeinde gesellschaft geschichte gesundheit grundlage "
    "handlung herrschaft kraftwerk landschaft leistung lieferung meinung mitglied möglichkeit pflicht rechnung regierung richtung schreiben schule schwierigkeit sicherheit sprache "
    "technik umgebung unternehmen verantwortung verbindung verfahren verhältnis versicherung verwaltung wirklichkeit wirtschaft wissenschaft zeitung zukunft zusammenhang "
    "administration appartement bibliothèque bonheur changement chateau commencement connaissance couleur département environnement essentiel établissement française gouvernement "
    "habituellement heureux institutionnel journaux logement maintenant maison mouvement naturellement nouveau particulier personnelle politique quelquefois rapidement recherche "
    "ciudad conocimiento construcción corazón desarrollo educación empresa enseñanza estudiante felicidad gobierno historia libertad mañana movimiento naturaleza necesario "
    "organización palabra pensamiento pueblo realidad seguridad sentimiento sociedad tiempo trabajo universidad verdadero"
).split()


def labelled_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """text, secret and unseen (kept from the models): n random strings in each of eight encodings, n ordinary strings in each of eight styles, by rule."""
    ids = spark.range(n)

    def word(k: int, of: list[str]) -> Column:
        return F.get(F.split(F.lit(" ".join(of)), " "), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(of))).cast("int"))

    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 256)
    letters = [F.translate(F.substring(digest, 1, 32), "0123456789", to) for to in ("ghijklmnop", "qrstuvwxyz", "kzmwgvtjhr")]
    random = F.array(digest, F.upper(F.substring(digest, 1, 40)), F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(F.substring(digest, 9, 48))), "+/=", "-_"), *letters, F.upper(letters[0]))
    w, common = [word(k, IDENTIFIER_WORDS) for k in range(4)], [word(k, COMMON_WORDS) for k in range(4, 7)]
    plain = F.array(
        F.concat_ws("_", *w), F.concat(w[0], *[F.initcap(x) for x in w[1:]]), F.concat_ws("-", w[0], w[1], w[2], F.pmod("id", F.lit(100)).cast("string")), F.concat_ws("/", *w), F.concat(*w), F.upper(F.concat_ws("_", *w)), F.concat(*common), F.initcap(F.concat(*common))
    )
    unseen = (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("unseen")
    return ids.select(F.explode(random).alias("text"), F.lit(True).alias("secret"), unseen).union(ids.select(F.explode(plain).alias("text"), F.lit(False).alias("secret"), unseen))


@dataclass(frozen=True)
class Model:
    """What the two models come to: the weight of each pair of characters, and the mean weight of a random string."""

    weights: tuple[float, ...]
    margin: float

    def ratio(self, text: Column) -> Column:
        """Mean log-likelihood ratio of a text's character pairs; pairs outside ASCII weigh nothing, one character has none."""
        table = F.split(F.lit(" ".join(f"{w:.6g}" for w in self.weights)), " ").cast("array<double>")
        signs = F.split(text, "")
        n = F.size(signs) - 1
        pairs = F.zip_with(F.slice(signs, F.lit(1), n), F.slice(signs, F.lit(2), n), lambda a, b: F.coalesce(F.get(table, F.ascii(a) * 128 + F.ascii(b)), F.lit(0.0)))
        return F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n)


def train(samples: DataFrame, false_alarms: float = FALSE_ALARMS) -> Model:
    """The models' weights, log P(second | first) among secrets less the same among ordinary strings, add-one smoothed.

    Samples marked unseen only choose the margin: at most that share of their ordinary strings may reach it, and where
    the classes lie apart it is halfway to the ratio that 99 % of their secrets reach. At most one row
    for each pair of ASCII characters is gathered. Null or one-character samples teach nothing.
    """
    known = samples.where(~F.col("unseen") & (F.length("text") > 1))
    signs = F.split("text", "")
    n = F.size(signs) - 1
    pairs = known.select("secret", F.explode(F.arrays_zip(F.slice(signs, F.lit(1), n).alias("a"), F.slice(signs, F.lit(2), n).alias("b"))).alias("p")).select("secret", "p.a", "p.b")
    counts = pairs.where((F.ascii("a") < 128) & (F.ascii("b") < 128)).groupBy("a", "b").agg(F.count_if("secret").alias("s"), F.count_if(~F.col("secret")).alias("o"))
    first = Window.partitionBy("a")
    chance = {k: F.log((F.col(k) + 1) / (F.sum(k).over(first) + ALPHABET)) for k in ("s", "o")}
    weights = [0.0] * (128 * 128)
    for r in counts.select((F.ascii("a") * 128 + F.ascii("b")).alias("at"), (chance["s"] - chance["o"]).alias("weight")).collect():
        weights[r["at"]] = r["weight"]
    model = Model(tuple(weights), 0.0)
    ratio, unseen = model.ratio(F.col("text")), samples.where("unseen")
    top = unseen.where(~F.col("secret")).agg(F.percentile(ratio, 1.0 - false_alarms)).first()[0] or 0.0
    low = unseen.where("secret").agg(F.percentile(ratio, 0.01)).first()[0] or 0.0
    return replace(model, margin=max(top, (top + low) / 2))


def _hits(text: Column, pattern: str, kind: str, present: Column) -> Column:
    """Every match in order, with the length of the gap before it and what counts of it."""
    whole = pattern.replace("(?i)", "(?i)(", 1) + ")" if kind == "assign" else f"({pattern})"
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    told = F.regexp_extract_all(text, F.lit(whole), F.lit(2)) if kind == "markov" else hits
    each = F.arrays_zip(parts.alias("gap"), hits.alias("hit"), told.alias("told"))
    found = F.transform(each, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"), x["told"].alias("told")))
    return F.when(present, found).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,hit:string,told:string>>"))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """The found spans of each document row, and at least one row with null kind for a row with none.

    Columns: row, doc_id, text_key (a hash of the text), kind, start, stop (code points, stop exclusive). Base kinds are
    as their patterns say, leftmost and non-overlapping for each kind. Stretches of LEAST or more characters of the
    alphabet outside base spans are candidates; one is added as kind markov when its mean log-likelihood ratio reaches
    the model's margin. Null and empty texts have no spans; repeated rows are scanned each on its own; a null doc_id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), text.alias("text"))
    t = F.col("text")
    found = F.concat(
        _hits(t, ASSIGN, "assign", t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")),
        _hits(t, ACCESS, "access", t.contains("AKIA")),
        _hits(t, "[0-9a-f]{16,}", "hex", t.rlike("[0-9a-f]{16}")),
        _hits(t, CANDIDATE, "markov", t.rlike(f"{ALLOWED}{{{LEAST}}}")),
    )
    each = rows.select("row", "doc_id", "text_key", F.explode_outer(found).alias("x")).select("row", "doc_id", "text_key", "x.*")
    order = Window.partitionBy("row", "kind").orderBy("i")
    size = F.length("hit")
    placed = each.withColumn("start", (F.sum(F.col("gap") + F.coalesce(size, F.lit(0))).over(order) - size).cast("long")).withColumn("stop", F.col("start") + size)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("told"))
    least = F.when(F.col("kind") == "assign", SHORTEST["assign"]).when(F.col("kind") == "access", SHORTEST["access"]).when(F.col("kind") == "hex", SHORTEST["hex"]).otherwise(LEAST)
    random = (F.col("kind") != "markov") | (model.ratio(F.when(F.col("kind") == "markov", F.col("told"))) >= model.margin)
    kept = (F.length(value) >= least) & random
    return placed.select("row", "doc_id", "text_key", *[F.when(kept, F.col(c)).alias(c) for c in ("kind", "start", "stop")])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """For each document row: doc_id, text_key, a count for each kind, and found: its spans (start, rank, kind, stop) in order."""
    rank = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    one = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "kind", "stop"))
    return spans(docs, model).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_key").alias("text_key"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.sort_array(F.collect_list(one)).alias("found"),
    )


def written(found: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret span (overlapping ones merged) replaced by the mark; n_chars follows. No row is dropped."""
    hit_id, hit_key, spans_of = unused(docs, "hit_id", "hit_key", "found")
    hits = scan(docs, model).where(F.size("found") > 0).select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key), F.col("found").alias(spans_of)).dropDuplicates([hit_id, hit_key])
    found = F.col(spans_of)
    # the stretches of the text that no span covers: from each furthest end so far to the next start beyond it
    begin = F.concat(F.array(F.lit(0).cast("long")), F.transform(found, lambda x, i: F.array_max(F.transform(F.slice(found, F.lit(1), i + 1), lambda y: y["stop"]))))
    end = F.concat(F.transform(found, lambda x: x["start"]), F.array(F.length("text").cast("long")))
    gaps = F.filter(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda g, i: (g["e"] > g["b"]) | (i == 0) | (i == F.size(found)))
    clean = F.array_join(F.transform(gaps, lambda g: F.substring(F.col("text"), (g["b"] + 1).cast("int"), F.greatest(g["e"] - g["b"], F.lit(0)).cast("int"))), mark)
    same = docs["doc_id"].eqNullSafe(F.col(hit_id)) & (F.xxhash64(docs["text"]) == F.col(hit_key))
    joined = docs.join(hits, same, "left").withColumn("text", F.when(found.isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(found.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
