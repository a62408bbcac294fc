"""Secret scans: candidates by pattern, false positives removed by a random forest, all on built-in functions.

The forest is trained on labelled findings, then written out as one Column expression, so candidates are found, measured, judged and
redacted within their row: no shuffle, and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import shared_path

#: A candidate: a run of at least 12 characters that keys are made of, with a digit and a letter; it begins where the run does. An
#: assignment sign parts it from a name before it.
RUN = r"A-Za-z0-9+/_~."
CANDIDATE = rf"(?<![{RUN}-])(?=[A-Za-z+/_~.-]*+[0-9])(?=[0-9+/_~.-]*+[A-Za-z])[{RUN}-]{{12,}}+={{0,2}}"
#: A name of a secret and an assignment; what follows it is a candidate from 8 characters on, whatever it is made of.
NAMED = r"(?i:key|token|secret|passw(?:or)?d|pwd|auth|credentials?)[\"'`]?\s{0,2}[:=]\s{0,2}[\"'`]?"
VALUE = r"[^\s\"'`,;<>(){}\[\]]{7,}[^\s\"'`,;<>(){}\[\].]"
WIDE = rf"(?<={NAMED}){VALUE}|{CANDIDATE}"
BEFORE, AFTER = 40, 20
MASK = "[SECRET]"

#: Words that stand in code and prose, in text of keys, beside keys, and beside other long strings.
DICTIONARY = "about above account after again apple application archive article assets backup before blog book build cache card cat center change channel chapter class client cloud code color command common company config content control copy country course data database date default demo design detail device dialog document domain download email english error event example export false family field file final first folder font form format forum free from function gallery game general global green group guide have header help history home host house html icon image import index info input install item java journal june label language large last layout learn level library light line link linux list live local login mail main make manager march market master media member menu message method mobile model module money month more music name network news next node note number object office online open option order other output page paper part password path people phone photo picture plan play plugin point policy post press price print private process product profile program project public query question random read record release remote report request resource result review room root sample school science script search section server service session setting share shop short show simple site size small social source space sport standard start state static status store story street string style support system table team template test text theme this time title token tool topic total travel true type update upload user value version video view water week with word work world write year".split()
BIGRAMS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
SYLLABLES = "ba ko mi tu re lan dor vis pel gan shu ter qua zim fo jer hud wex ny clo bri sta gru plo vek sol dam hin".split()
KEYWORDS = "key token secret passw pwd auth credential bearer private apikey access_id signature"
OTHER_WORDS = "commit sha1 sha256 md5 hash digest checksum uuid guid version revision id ref branch build http www file path image href src isbn doi order invoice example"

#: A candidate's columns, in the order of the forest's features.
FEATURES = (
    "length", "digits", "upper", "lower", "signs", "hex", "changes", "distinct", "bigrams", "covered", "slashes", "dots",
    "known_prefix", "key_word", "other_word", "assigned", "quoted", "path_before", "at_after", "dashes",
)


def _either(words) -> str:
    return "|".join(words if not isinstance(words, str) else words.split())


def measured(value: Column, before: Column, after: Column) -> list[Column]:
    """The features of a candidate and its neighbours."""
    n = F.length(value).cast("double")
    share = lambda cls: F.regexp_count(value, F.lit(cls)) / n
    near, low = F.lower(before), F.lower(value)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return [
        c.cast("double").alias(name)
        for name, c in zip(
            FEATURES,
            (
                F.least(n, F.lit(200.0)), share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"),
                flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
                share("[a-z](?=[^a-z])|[A-Z](?=[^A-Za-z])|[0-9](?=[^0-9])"),
                F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64.0)),
                F.regexp_count(low, F.lit(f"(?=(?:{_either(BIGRAMS)}))")) / n,
                1 - F.length(F.regexp_replace(low, _either(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
                F.regexp_count(value, F.lit("/")), F.regexp_count(value, F.lit(r"\.")),
                flag(value.rlike("^(AKIA[0-9A-Z]{12}|gh[pousr]_|xox[baprs]-|sk_live_|sk-|AIza|eyJ[A-Za-z0-9_-]{8}|glpat-|npm_)")),
                flag(near.rlike(_either(KEYWORDS))), flag(near.rlike(rf"\b({_either(OTHER_WORDS)})\b")),
                flag(before.rlike(r"[=:]\s*[\"'`]?$")), flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
                flag(before.rlike(r"[/\\@]$|https?:\S*$")), flag(after.startswith("@")), F.regexp_count(value, F.lit("-")),
            ),
            strict=True,
        )
    ]


# --- labelled findings ----------------------------------------------------------------------------------------------------------


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """value, before, after, label: `rows` findings made by rule from hashes. Half are keys in the ways that they are written down.

    What several columns are made of has a column of its own and lists of words are one constant each, so that the driver has few
    expressions to hold, plan and compile.
    """
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    pick = lambda words, salt: F.element_at(F.split(F.lit("\n".join(words)), "\n", -1), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    # half of the words are in no dictionary, so that coverage alone doesn't tell labels apart
    made = lambda salt: F.concat(*[pick(SYLLABLES, salt + part) for part in (100, 200, 300)])
    made_or_known = lambda salt: F.when(F.pmod(F.xxhash64("id", F.lit(salt + 400)), F.lit(2)) == 0, pick(DICTIONARY, salt)).otherwise(made(salt))
    numbers = {"number": F.pmod(F.xxhash64("id", F.lit(99)), F.lit(9000)) + 10, "k": F.pmod(F.xxhash64("id", F.lit(7)), F.lit(12))}
    base = spark.range(rows).select("id", h.alias("h"), b64.alias("b64"), *[c.alias(n) for n, c in numbers.items()], *[made_or_known(salt).alias(f"word{salt}") for salt in range(1, 7)])
    h, b64, number, k = (F.col(n) for n in ("h", "b64", "number", "k"))
    word = lambda salt: F.col(f"word{salt}")
    date = F.concat(F.lit("20"), F.lpad(F.pmod(number, F.lit(30)).cast("string"), 2, "0"), F.lit("-0"), (F.pmod(number, F.lit(9)) + 1).cast("string"), F.lit("-1"), F.pmod(number, F.lit(10)).cast("string"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    keys = [
        F.substring(h, 1, 40), F.substring(h, 1, 32), h, F.substring(b64, 1, 40), F.substring(b64, 1, 24), F.substring(b64, 1, 20),
        F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 1, 16))), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)),
        F.concat(F.lit("xoxb-"), F.substring(F.conv(F.substring(h, 1, 12), 16, 10), 1, 12), F.lit("-"), F.substring(b64, 1, 24)), F.concat(F.lit("eyJhbGciOi"), F.substring(b64, 1, 30), F.lit("."), F.substring(b64, 5, 30)), uuid,
    ]
    others = [
        F.concat(word(1), F.lit("."), F.lpad(F.pmod(number, F.lit(100)).cast("string"), 2, "0")), F.concat(word(1), word(2), number.cast("string")), F.concat_ws("-", word(1), word(2), word(3), number.cast("string")),
        F.concat(word(1), F.lit("/"), word(2), F.lit("/"), number.cast("string"), F.lit(".html")), F.concat(date, F.lit("-"), word(1)), F.concat(word(1), F.lit("_"), word(2), F.lit("_v"), F.pmod(number, F.lit(9)).cast("string")),
        F.substring(h, 1, 40), uuid, h, F.substring(h, 1, 32), F.concat(F.lit("mail"), F.pmod(number, F.lit(10)).cast("string"), F.lit(".example.com")), F.concat(word(1), F.lit("."), number.cast("string"), F.lit("."), word(2)),
    ]
    key_before = ['token = "', 'api_key="', "secret: ", 'password = "', "AUTH_TOKEN=", 'private_key: "', "Authorization: Bearer ", 'client_secret = "', "access key ", "credentials: ", "'apiKey': '", "passwd="]
    bare_before = ["see ", "was the ", "at ", "and then ", "In the ", "/", "by ", "to "]
    hash_before = ["commit ", "sha256 ", "md5: ", "checksum ", "uuid ", "revision ", "digest: sha256=", "id = ", "build ", "branch "]
    of = lambda options: F.element_at(F.array(*options), (k + 1).cast("int"))
    quoted = lambda before: F.when(before.rlike("\"$"), F.lit('" ')).when(before.rlike("'$"), F.lit("',")).otherwise(F.lit(" "))
    # behind a name and an assignment: pass phrases and short keys, against plain words, names and placeholders
    letters = F.regexp_replace(b64, "[^A-Za-z]", "")
    named_keys = [F.concat(F.initcap(word(1)), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4))), F.substring(h, 1, 10), F.concat(F.initcap(word(1)), number.cast("string"), F.lit("!")), F.substring(letters, 1, 20)]
    named_words = [F.rpad(word(1), 8, "s"), F.concat(word(1), F.lit("_"), word(2)), F.concat(F.lit("your-"), word(1), F.lit("-"), word(2)), F.concat(word(1), F.lit("."), word(2), F.lit("()"))]
    named = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(4)) == 0
    which = lambda options: F.element_at(F.array(*options), (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(len(options))) + 1).cast("int"))
    yes_before = F.concat(word(5), F.lit(" "), F.when(~named & (k >= 6) & (k <= 10) & (F.col("id") % 4 == 0), pick(bare_before, 8)).otherwise(pick(key_before, 8)))
    yes = base.filter("id % 2 = 0").select(F.when(named, which(named_keys)).otherwise(of(keys)).alias("value"), yes_before.alias("before"))
    yes = yes.select("value", "before", quoted(F.col("before")).alias("after"), F.lit(1.0).alias("label"))
    hashed = (k >= 6) & (k <= 9)
    # a few plain words stand behind a key word too: the word alone doesn't make a secret
    no_before = F.concat(word(6), F.lit(" "), F.when(named, pick(key_before, 10)).when(hashed, pick(hash_before, 9)).when(F.col("id") % 10 == 1, pick(key_before, 10)).otherwise(pick(bare_before, 10)))
    no_after = F.when(~named & (k == 0), F.concat(F.lit("@mail"), number.cast("string"), F.lit(".example.com"))).otherwise(quoted(F.col("before")))
    no = base.filter("id % 2 = 1").select(F.when(named, which(named_words)).otherwise(of(others)).alias("value"), no_before.alias("before"), "id", "number", "k")
    no = no.select("value", "before", no_after.alias("after"), F.lit(0.0).alias("label"))
    return yes.unionByName(no)


def train(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 5) -> RandomForestClassificationModel:
    """A random forest on findings (value, before, after, label)."""
    rows = findings.select(*measured(F.col("value"), F.col("before"), F.col("after")), "label")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)


def forest(model: RandomForestClassificationModel, feature) -> Column:
    """The model's probability of label 1, as an expression; feature(k) is the column of feature k.

    The trees' nodes are read from the saved model: `trees * 2 ** (depth + 1)` rows at most. They stand in constant arrays that are
    walked from the roots, so the expression that the driver plans is as small whatever the number of nodes.
    """
    spark = SparkSession.active()
    path = shared_path(spark, "secret-forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").selectExpr(
        "treeID", "nodeData.id", "nodeData.impurityStats as counts", "nodeData.leftChild as left", "nodeData.rightChild as right",
        "nodeData.split.featureIndex as feature", "get(nodeData.split.leftCategoriesOrThreshold, 0) as threshold",
    )
    nodes = sorted(rows.collect(), key=lambda r: (r["treeID"], r["id"]))
    place = {(r["treeID"], r["id"]): k for k, r in enumerate(nodes)}
    inner = [r["left"] >= 0 for r in nodes]
    constant = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    # a leaf leads to itself, on both sides
    side = lambda name: constant([place[r["treeID"], r[name]] if i else k for k, (r, i) in enumerate(zip(nodes, inner, strict=True))], "int")
    left, right = side("left"), side("right")
    chosen = constant([r["feature"] if i else 0 for r, i in zip(nodes, inner, strict=True)], "int")
    threshold = constant([r["threshold"] if i else 0.0 for r, i in zip(nodes, inner, strict=True)], "double")
    share = constant([r["counts"][1] / sum(r["counts"]) for r in nodes], "double")
    roots = [place[tree, 0] for tree in sorted({r["treeID"] for r in nodes})]
    steps = F.sequence(F.lit(1), F.lit(max(t.depth for t in model.trees) + 1))

    def summed(x: Column) -> Column:
        step = lambda at, _: F.when(F.get(x, F.get(chosen, at)) <= F.get(threshold, at), F.get(left, at)).otherwise(F.get(right, at))
        return F.aggregate(constant(roots, "int"), F.lit(0.0), lambda total, root: total + F.get(share, F.aggregate(steps, root, step)))

    # the features are bound to a variable once
    return F.transform(F.array(F.array(*[feature(k) for k in range(len(FEATURES))])), summed)[0] / len(roots)


def running(numbers: Column) -> Column:
    """Running sums of an array of ints. Sums go over runs of about the root of its length, as an array that grows is copied with every number."""

    def sums(x, of):
        return F.slice(F.aggregate(x, F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.element_at(a, -1) + of(e)))), 2, F.size(x))

    def whole(x):
        run = F.ceil(F.sqrt(F.size(x))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / run).cast("int")), lambda k: F.slice(x, k * run + 1, run))
        ends = F.transform(runs, lambda r: sums(r, lambda e: e))
        upto = F.transform(F.array(ends), lambda e: F.arrays_zip(e.alias("e"), F.concat(F.array(F.lit(0)), sums(e, lambda r: F.element_at(r, -1))).alias("before")))[0]
        return F.flatten(F.transform(F.filter(upto, lambda r: r["e"].isNotNull()), lambda r: F.transform(r["e"], lambda v: v + r["before"])))

    # each array is bound to a variable once, as an expression that is named twice is computed twice
    return F.when(F.size(numbers) > 0, F.transform(F.array(numbers), whole)[0]).otherwise(F.array().cast("array<int>"))


FINDING = "array<struct<value:string,start:int,score:double,secret:boolean>>"


def scan(docs: DataFrame, model: RandomForestClassificationModel, least: float = 0.5) -> DataFrame:
    """Adds findings (value, start, score, secret) and clean_text, in which every value that is a secret anywhere in the text is masked.

    Whole texts are searched. Null texts have no findings and a null clean_text; rows pass through one to one, so repeated rows, null
    ids and other columns stay (columns named findings or clean_text, or beginning with an underscore, are not passed on); an empty
    table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("findings", "clean_text") and not c.startswith("_")]
    body = F.coalesce("text", F.lit(""))
    # looking behind every place is dear, and of no use in a text without a named value
    out = docs.select(*kept, body.rlike(NAMED).alias("_named"))
    named = F.col("_named")
    out = out.select(*kept, "_named", F.when(named, F.regexp_extract_all(body, F.lit(WIDE), F.lit(0))).otherwise(F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0))).alias("_values"))
    parts = F.when(F.size("_values") > 0, F.when(named, F.split(body, WIDE, -1)).otherwise(F.split(body, CANDIDATE, -1))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("_parts", parts)
    n = F.size("_values")
    zipped = F.arrays_zip(F.col("_values").alias("v"), F.slice("_parts", 1, n).alias("b"), F.slice("_parts", 2, n).alias("a"))
    # a candidate that touches the last one has nothing before it: neighbours are cut at other candidates
    shown = F.transform(zipped, lambda e: F.struct(e["v"].alias("v"), F.right(e["b"], F.lit(BEFORE)).alias("b"), F.left(e["a"], F.lit(AFTER)).alias("a"), (F.length(e["b"]) + F.length(e["v"])).alias("n")))
    rated = F.transform(F.transform(shown, lambda e: F.struct(e["v"].alias("v"), e["n"].alias("n"), *measured(e["v"], e["b"], e["a"]))), lambda e: F.struct(e["v"].alias("v"), e["n"].alias("n"), forest(model, lambda k: e[FEATURES[k]]).alias("p")))
    out = out.withColumn("_rated", rated)
    placed = F.transform("_rated", lambda e, i: F.struct(e["v"].alias("value"), i.alias("start"), e["p"].alias("score"), (e["p"] >= least).alias("secret")))
    out = out.withColumns({"_ends": running(F.transform("_rated", lambda e: e["n"])), "_placed": placed})
    findings = F.zip_with("_placed", "_ends", lambda e, s: F.struct(e["value"].alias("value"), (s - F.length(e["value"])).alias("start"), e["score"].alias("score"), e["secret"].alias("secret")))
    out = out.withColumn("findings", findings.cast(FINDING))
    bad = F.array_distinct(F.transform(F.filter("findings", lambda e: e["secret"]), lambda e: e["value"]))
    # longest first, so that a value within another doesn't leave the rest of it
    ordered = F.transform(F.sort_array(F.transform(bad, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda e: e["v"])
    out = out.withColumn("_bad", ordered)
    out = out.withColumn("clean_text", F.when(F.size("_bad") > 0, F.aggregate("_bad", F.col("text"), lambda t, v: F.replace(t, v, F.lit(MASK)))).otherwise(F.col("text")))
    return out.select(*kept, "findings", "clean_text")
