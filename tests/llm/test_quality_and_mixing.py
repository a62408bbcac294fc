import collections
import math
import pathlib
import random
import re
import time

from pyspark.sql import functions as F

from quillframe.llm import mixing, quality_rules
from quillframe.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA, same_as_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen = collections.Counter(windows)
    covered = {k + j for k, g in enumerate(windows) if seen[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  \n\t", "a b c a b c", "a a a a a", "x\ny\nx", "#*$ é | ~", "one two"]
    texts += ["".join(rng.choice(["ab ", "c ", "d\n", "e|\t", "f\x0b", "\x1c"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts.append("w " * 5000 + " ".join(map(str, range(3000))))
    df = quality_rules.clean_lines(docs(spark, [(k, t, "s") for k, t in enumerate(texts)]))
    for r in df.collect():
        want = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]


def test_very_long_text_takes_the_other_sort(spark):
    text = " ".join(str(k % 70_000) for k in range(140_000))
    r = quality_rules.clean_lines(docs(spark, [(1, text, "s")])).first()
    assert r["n_words"] == 140_000 and r["n_repeat_words"] == 140_000


def test_verdicts(spark):
    good = "\n".join(" ".join(f"plain{k}word{j}" for j in range(12)) + "." for k in range(6))
    bad_lines = "\n".join(f"Home | About{k} | Contact{k} | Shop{k} | Cart{k}" for k in range(20))
    rows = [(1, good, "s"), (2, good + "\n" + bad_lines, "s"), (3, good.upper(), "s"), (4, "short text.", "s"), (None, None, None), (1, good, "s")]
    got = {(r["doc_id"], r["kept"], r["base_failed"]) for r in quality_rules.clean_lines(docs(spark, rows).withColumn("kept", F.lit("clash")).withColumn("_words", F.lit(1))).collect()}
    assert got == {(1, True, False), (2, False, False), (3, False, False), (4, False, True), (None, False, True)}
    assert quality_rules.clean_lines(docs(spark, [])).count() == 0


def test_lines_of_four_languages(spark):
    fails = ["Home", "Startseite", "MENÚ ›", "À propos", "Lire la suite »", "Alle Rechte vorbehalten.", "Conditions d'utilisation.", "Todos los derechos reservados 2024.", "a line of some six words", "one two three four five six seven eight nine ten"]
    holds = ["A sentence.", "Kontaktfreudig war sie.", "Ein Satz mit Ende!", "这是一句话。", "One sentence ends. The next of them was cut off at its"]
    lines = [(k, x, "s") for k, x in enumerate(fails + holds)]
    got = {r["doc_id"]: r["clean_text"] for r in quality_rules.clean_lines(docs(spark, lines)).collect()}
    assert [got[k] == x for k, x, _ in lines] == [False] * len(fails) + [True] * len(holds)


def test_line_rules_query_equals_sql(spark):
    same_as_sql(spark, QUERIES["op10_line_rules"](spark, DATA), ORACLE["op10_line_rules"])


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda x: (x is None, x))
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[n] for n in full)
        rest = [n for n in names if n not in full]
        share = {n: left * w[n] / sum(w[m] for m in rest) for n in rest}
        over = {n for n in rest if share[n] > cap * sizes[n]}
        if not over:
            return {n: cap * sizes[n] if n in full else share[n] for n in names}
        full |= over


def test_targets_against_repeated_sharing(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {n: rng.choice([0, 1, 5, 40, 300, 2000]) for n in ["a", "b", "Z", "é", None, "zz", "c"]}
        if not sum(sizes.values()):
            continue
        got = mixing.source_targets(spark.createDataFrame([(n, v) for n, v in sizes.items()], "source string, size long")).collect()
        want = brute_targets(sizes)
        assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in got)


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randint(0, 400), rng.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for k in range(600)] + [(None, None, "a"), (7, "x y", "b"), (7, "x y", "b")]
    df = docs(spark, rows)
    out, slots = mixing.mix_sources(df, block_words=16)
    got = out.collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 16 for s in target)
    again = mixing.mix_sources(df.repartition(7), block_words=16)[0].collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    # a pass takes each block once at most
    assert slots.groupBy("source_id", "pass", "block").count().filter("count > 1").count() == 0
    assert mixing.mix_sources(docs(spark, []))[0].count() == 0


def test_mix_holds_the_words_of_each_block(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(rng.randint(0, 90))).replace(" ", rng.choice([" ", "\n", " \t "])), rng.choice(["a", "b", None])) for k in range(200)]
    sizes = {k: len(t.split()) for k, t, _ in rows}
    out, slots = mixing.mix_sources(docs(spark, rows), block_words=16, shard_slots=50)
    got, mix = out.collect(), slots.collect()
    seen, blocks = collections.Counter(), {}
    for r in mix:
        tokens = r["tokens"]
        assert sum(p["n"] for p in r["parts"]) == len(tokens) <= 16 and tokens
        seen.update(int(t[1:].split("w")[0]) for t in tokens)
        assert blocks.setdefault((r["source_id"], r["block"]), tokens) == tokens
    assert {r["doc_id"]: r["taken"] for r in got} == {k: seen[k] for k in sizes}
    assert len({r["shard"] for r in mix}) > 1
    # blocks in order hold each document's words once and in order, and all but the last are full
    for source in {s for s, _ in blocks}:
        mine = [blocks[s, b] for s, b in sorted(blocks) if s == source]
        numbers = [b for s, b in sorted(blocks) if s == source]
        if numbers == list(range(len(numbers))):
            assert all(len(b) == 16 for b in mine[:-1])
            by_doc = collections.defaultdict(list)
            for t in sum(mine, []):
                by_doc[int(t[1:].split("w")[0])].append(int(t.split("w")[1]))
            assert all(v == list(range(sizes[k])) for k, v in by_doc.items())


def test_passes_are_permutations_of_any_number_of_blocks(spark):
    counts = [1, 2, 7, 1000, (1 << 31) - 1, mixing.PRIMES[0], 3 * mixing.PRIMES[2], 1 << 40, (1 << 55) + 11]
    df = spark.createDataFrame([(k, b, 3 * b) for k, b in enumerate(counts)], "source_id int, blocks long, quota long")
    rows = mixing.passes(df, 3, 17)
    steps = set()
    for r in rows.collect():
        assert [p["pass"] for p in r["passes"]] == [0, 1, 2]
        for p in r["passes"]:
            assert math.gcd(p["step"], r["blocks"]) == 1 and 0 <= p["shift"] < r["blocks"]
            steps.add(p["step"])
    assert len(steps) > 15
    at = rows.withColumn("p", F.explode("passes")).withColumn("block", F.explode(F.array(F.lit(0).cast("long"), F.col("blocks") - 1, F.floor(F.col("blocks") / 2))))
    at = at.withColumn("slot", mixing.slot_of(F.col("block"), F.col("p"), F.col("blocks"))).withColumn("again", mixing.block_of(F.col("slot"), F.col("p"), F.col("blocks")))
    for r in at.collect():
        assert r["slot"] == r["p"]["pass"] * r["blocks"] + (r["p"]["step"] * r["block"] + r["p"]["shift"]) % r["blocks"]
        assert r["again"] == r["block"]
    # a pass that the quota does not reach is not made
    few = spark.createDataFrame([(0, 10, 11), (1, 10, 10), (2, 0, 0)], "source_id int, blocks long, quota long")
    assert [len(r["passes"] or []) for r in mixing.passes(few, 3, 17).orderBy("source_id").collect()] == [2, 1, 0]


def test_mix_offsets_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 2)
    rows = [(k, f"w{k} " * (k % 5), "a" if k % 3 else "b") for k in range(9000)]
    out, slots = mixing.mix_sources(docs(spark, rows), block_words=8)
    taken = {r["doc_id"]: r["taken"] for r in out.collect()}
    seen = collections.Counter(t for r in slots.select("tokens").collect() for t in r["tokens"])
    assert all(taken[k] == seen[f"w{k}"] for k, _, _ in rows)
    # all pieces of a block are there: blocks but a source's last are full
    short = slots.filter(F.size("tokens") < 8).select("source_id", "block").distinct().groupBy("source_id").count().collect()
    assert all(r["count"] == 1 for r in short)


def test_mix_frees_the_shuffles_of_texts(spark):
    """When the mix is written, neither the texts' shuffle nor the pieces' is on disk; each shard is in one file, whatever the round."""
    rng = random.Random(8)
    rows = [(k, " ".join("%015x" % rng.getrandbits(60) for _ in range(400)), rng.choice("ab")) for k in range(600)]
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f: f.stat().st_size for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data") if f.exists()}
    before = shuffled()
    out, slots = mixing.mix_sources(docs(spark, rows), shard_slots=500)
    for _ in range(50):  # files go in the background
        left = sum(n for f, n in shuffled().items() if f not in before)
        if left < 400_000:
            break
        time.sleep(0.1)
    assert left < 400_000  # the texts have 3.8 MB
    files = slots.select("shard", F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == len({r["shard"] for r in files}) > 10
    assert out.agg(F.sum("taken")).first()[0] == slots.agg(F.sum(F.size("tokens"))).first()[0] > 230_000
