import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute, data
from tidemark.llm import decontamination as C
from tidemark.llm import language_id as L
from tidemark.llm import line_dedup as N

BENCH = "item_id long, text string"
QUESTION = "A farmer called Tom Baker has 12 apples and gives Anna 5 kg of them before Tom Baker leaves"


def found(spark, texts, items=(QUESTION,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = C.contaminated(docs, spark.createDataFrame(list(enumerate(items)), BENCH)).collect()
    return {r["doc_id"] for r in rows}


def test_templates(spark):
    texts = [
        "Before. " + QUESTION + " after",
        QUESTION.lower(),  # names can't be told from words
        QUESTION.replace("12", "37").replace("5 kg", "9 lb").replace("Anna", "Maria").replace("Tom Baker", "Eva Stone"),
        "She said Eva has 3 pears and gives Max 2",
        "nothing of the kind is in this text at all, not a window of it",
        None,
        "",
    ]
    assert found(spark, texts) == {0, 1, 2}


def test_slots_must_be_consistent(spark):
    item = "when Tom has 3 then Anna has 3"
    same, other = "when Max has 8 then Eva has 8", "when Max has 8 then Eva has 9"
    assert found(spark, [same, other], [item]) == {0}


def test_names_that_begin_sentences(spark):
    item = "Natalia sold clips to 48 of her friends"
    three = "Tom runs to the market. Anna sings at home. Eva paints a wall"
    texts = ["Maria sold clips to 30 of her friends", "Yes. Max runs to the market. Ida sings at home. Zoe paints a wall. No", "natalia sold clips to 9 of her friends", "Maria sold cards to 30 of her friends"]
    assert found(spark, texts, [item, three]) == {0, 1, 2}


def test_one_assignment_holds_over_all_windows(spark):
    item = "Tom has 12 red apples in a box and then Tom gives Anna 5 of them before Tom goes home with Anna"
    whole = item.replace("Tom", "Max").replace("Anna", "Ida").replace("12", "31").replace("5", "7")
    torn = "Eva" + whole.replace("Max", "Eva", 2)[3:]  # Tom is Eva first and Max later
    merged = whole.replace("Max", "Ida")
    assert found(spark, [whole, torn, merged], [item]) == {0}
    assert found(spark, [item.replace("12", "13"), torn + " " + item], [item]) == {0, 1}  # its own windows count in any case


def test_windows_of_few_words_and_scripts_without_spaces(spark):
    items = ["What is 12 + 7?", "3 + 4 = 7, 12 - 5 = 7", "今日は良い天気ですね"]
    texts = ["so what is 12 + 7 then", "what is 13 + 7", "3+4=7 and 12-5=7", "3 4 7 12 5 7", "彼は今日は良い天気ですねと言った", "今日は雨です"]
    assert found(spark, texts, items) == {0, 3, 4}


def substituted(rnd, question, words):
    """A question with other names and numbers, one to one."""
    new = {}
    for w in sorted(set(words)):
        while (x := rnd.choice(("Nadia", "Oskar", "Piet", "Quinn", "Rosa", "Sven", "Theo", "Uma")) if w.isalpha() else str(rnd.randint(2, 999))) in new.values():
            pass
        new[w] = x
    return re.sub(r"\b(" + "|".join(map(re.escape, new)) + r")\b", lambda m: new[m[0]], question)


def test_recall_of_reparameterised_questions(spark):
    """Questions from patterns, each with its copies under other names and numbers inside other text, and with torn copies."""
    rnd = random.Random(12)
    nouns, verbs = "apples coins books stamps marbles tickets".split(), "buys sells finds loses counts borrows".split()
    items, good, torn = [], [], []
    for _ in range(60):
        a, b = rnd.sample(("Tom", "Anna", "Eva", "Max"), 2)
        n, m = rnd.sample(range(2, 99), 2)
        thing, verb = rnd.choice(nouns), rnd.choice(verbs)
        q = rnd.choice((
            f"{a} {verb} {n} {thing} on Monday and {b} {verb} {m} more. How many {thing} does {a} have when {b} returns {n} of them?",
            f"On a trip {a} {verb} {n} {thing} for {m} dollars. Then {b} asks {a} to share. {a} keeps {m} and gives the rest to {b}.",
            f"{a} and {b} share {n} {thing}. {a} {verb} {m} while {b} takes none. What part of the {n} {thing} is left?",
        ))
        items.append(q)
        words = [a, b, str(n), str(m)]
        good.append(f"{data.prose(rnd, 30)}. {substituted(rnd, q, words)} {data.prose(rnd, 30)}")
        torn.append(f"{data.prose(rnd, 30)}. " + re.sub(rf"\b({'|'.join(words)})\b", lambda m: f"{m[0]}{rnd.randint(100, 10**6)}" if m[0].isdigit() else "Z" + data.prose(rnd, 1).replace("-", "") + rnd.choice("abcdefgh") * 3, q))
    docs = list(enumerate(good + torn))
    rows = C.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), BENCH)).collect()
    hits = {(r["doc_id"], r["item_id"]) for r in rows}
    assert sum((i, i) in hits for i in range(60)) >= 54
    assert sum((60 + i, i) in hits for i in range(60)) <= 6  # a torn copy counts only by a window that has values of its own once
    # a document is held by an item only where the two fit: brute force over all windows of all pairs
    assert not {d for d, i in hits if d < 60 and items[i].split()[0] != items[d].split()[0] and not set(good[d].split()) & set(items[i].split())}


FIRST = "Nadia Oskar Piet Quinn Rosa Sven Theo Uma Viola Wanda Xaver Yusuf Zora Bruno Carla Dario".split()
LAST = "Almond Birch Cedar Dogwood Elder Fir Ginkgo Hazel Ivy Juniper".split()


def renamed(rnd, question, names, numbers, spell):
    """A question with names of one to three words and other numbers, one to one; numbers below a hundred in words at times."""
    new, used = {}, set()
    for n in names:
        while (x := " ".join([rnd.choice(FIRST), *rnd.sample(LAST, rnd.randint(0, 2))])) in used:
            pass
        new[n] = x
        used.add(x)
    for n in numbers:
        while (x := rnd.choice(C.CARDINALS[2:20]) if spell else str(rnd.randint(2, 999))) in used:
            pass
        new[n] = x
        used.add(x)
    return re.sub(r"\b(" + "|".join(map(re.escape, new)) + r")\b", lambda m: new[m[0]], question)


def questions(rnd, n):
    nouns, verbs = "apples coins books stamps marbles tickets".split(), "buys sells finds loses counts borrows".split()
    for _ in range(n):
        a, b = rnd.sample(("Tom", "Anna", "Eva", "Max"), 2)
        x, y = rnd.sample(range(2, 99), 2)
        thing, verb = rnd.choice(nouns), rnd.choice(verbs)
        q = rnd.choice((
            f"{a} {verb} {x} {thing} on market day and {b} {verb} {y} more. How many {thing} does {a} have when {b} returns {x} of them?",
            f"On a trip {a} {verb} {x} {thing} for {y} dollars. Then {b} asks {a} to share. {a} keeps {y} and gives the rest to {b}.",
            f"{a} and {b} share {x} {thing}. {a} {verb} {y} while {b} takes none. What part of the {x} {thing} is left?",
        ))
        yield q, [a, b], [str(x), str(y)]


@pytest.mark.parametrize("kind", ["names", "numbers", "lower", "upper"])
def test_recall_of_copies_with_long_names_number_words_and_other_case(spark, kind):
    rnd = random.Random(21)
    items, docs = [], []
    for q, names, numbers in questions(rnd, 60):
        items.append(q)
        copy = renamed(rnd, q, names, numbers, spell=kind == "numbers")
        copy = copy.lower() if kind == "lower" else copy.upper() if kind == "upper" else copy
        docs.append(f"{data.prose(rnd, 30)}. {copy} {data.prose(rnd, 30)}.")
    rows = C.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), BENCH)).collect()
    recall = sum((i, i) in {(r["doc_id"], r["item_id"]) for r in rows} for i in range(60)) / 60
    print(kind, recall)
    assert recall >= 0.9


def test_names_of_any_length_are_one_slot(spark):
    item = "Then Tom gives Anna 5 apples and Anna thanks Tom"
    texts = [
        "Then Eva Stone gives Ida Marie 7 apples and Ida Marie thanks Eva Stone",
        "Then Eva gives Ida seven apples and Ida thanks Eva",
        "then eva gives ida 7 apples and ida thanks eva",
        "THEN EVA GIVES IDA SEVEN APPLES AND IDA THANKS EVA",
        "Then Eva Stone gives Ida Marie 7 apples and Eva Stone thanks Ida Marie",
        "Then Eva gives Ida 7 apples and Ida eats them all at home",
        "then somebody gave apples to her friends and nobody thanks tom",
    ]
    assert found(spark, texts, [item]) == {0, 1, 2, 3}


def test_clean_prose_in_lower_case_stays(spark):
    rnd = random.Random(5)
    items = [q for q, _, _ in questions(rnd, 40)]
    assert found(spark, [data.prose(rnd, 400) for _ in range(20)] + ["she has apples and he has books and when they meet they share them all with others " * 5], items) == set()


def test_short_items_and_nothing(spark):
    assert found(spark, ["the capital of france is paris", "what is paris"], ["capital of france", "is", None, ""]) == {0}
    d, b = data.docs(spark), spark.createDataFrame([], BENCH)
    assert C.contaminated(d, b).count() == 0
    assert C.decontaminate(d, b).count() == d.count()
    assert C.contaminated(data.nothing(spark), spark.createDataFrame([(1, QUESTION)], BENCH)).count() == 0


def test_windows_against_brute_force(spark):
    """On plain words a template is the text itself: a document is contaminated where it shares a run of 8 words."""
    d = data.docs(spark)
    item = data.texts()[12].split()
    bench = spark.createDataFrame([(1, " ".join(item[3:17]))], BENCH)
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    runs = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    want = {r[0] for r in data.rows() if runs(words(r[1])) & runs(words(" ".join(item[3:17])))}
    got = C.contaminated(d, bench).collect()
    assert {r["doc_id"] for r in got} == want and want
    clean = C.decontaminate(d, bench)
    assert clean.columns == d.columns
    assert sorted(repr(r["text"]) for r in clean.collect()) == sorted(repr(r[1]) for r in data.rows() if r[0] not in want or not runs(words(r[1])) & runs(words(" ".join(item[3:17]))))


def test_blocks_change_nothing(spark, monkeypatch):
    d, b = data.docs(spark), spark.createDataFrame([(i, t) for i, t in enumerate(data.texts()[9:20])], BENCH)
    whole = {tuple(r) for r in C.contaminated(d, b).collect()}
    monkeypatch.setattr(C, "BLOCK_WINDOWS", 100)
    assert {tuple(r) for r in C.contaminated(d, b).collect()} == whole and whole


def test_long_runs_of_junk(spark):
    assert found(spark, ["-.,;!" * 50_000 + QUESTION, "1,2." * 50_000, "A" * 200_000]) == {0}


def test_line_dedup(spark):
    block = "\n".join(f"line {i} of a block that is shared" for i in range(40))
    extra = [(900 + i, f"own {i}\n{block}\nend {i}", "en", "b", 0, 0, "c", "k") for i in range(5)]
    d = spark.createDataFrame(data.rows() + extra, data.SCHEMA).repartition(3)
    got = N.line_dedup(d).collect()
    assert len(got) == d.count()
    # places in order: ids, then a hash of the row for those that share one
    rows = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text")).distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["key"]))
    left = brute.lines_left([((r["doc_id"], r["key"]), r["text"]) for r in rows])
    assert {(r["doc_id"], r["clean_text"]) for r in got} == {(doc, text) for (doc, _), text in left.items()}
    of = {r["doc_id"]: r for r in got}
    assert of[900]["removed_lines"] == 0 and all(of[900 + i]["removed_lines"] >= 20 for i in range(1, 5))
    assert all(of[900 + i]["clean_text"].startswith(f"own {i}") for i in range(1, 5))
    assert N.line_dedup(data.nothing(spark)).count() == 0


def cleaned(spark, texts):
    rows = N.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["clean_text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_line_dedup_of_odd_lines_against_brute_force(spark):
    """Few different lines in many orders: chunks and runs that overlap, in one text and across texts."""
    rnd = random.Random(11)
    for kinds, longest in ((3, 6), (6, 12), (25, 40)):
        texts = ["\n".join(rnd.choice(("", " ", *(f"line {k}" for k in range(kinds)))) for _ in range(rnd.randint(0, longest))) for _ in range(60)]
        texts += [texts[-1], texts[-2] + "\n" + texts[-3], "\n\n\n\n", "a\n\n\nb", "c\n\n\nd"]
        want = brute.lines_left(list(enumerate(texts)))
        assert cleaned(spark, texts) == [want[i] for i in range(len(texts))]


def test_first_places_are_broadcast_by_rows_and_bytes(spark, monkeypatch):
    """A few first places whose neighbours have many lines are too large for the driver; shuffled, the result is the same."""
    none = F.array().cast("array<bigint>")
    often = lambda n: spark.range(10).select(F.struct(F.sequence(F.lit(1), F.lit(n).cast("long")).alias("before"), none.alias("after")).alias("keeper"))
    assert N.fits(often(10)) and not N.fits(often(200_000))
    rnd = random.Random(5)
    texts = ["\n".join(f"line {rnd.randint(0, 9)}" for _ in range(30)) for _ in range(20)]
    want = brute.lines_left(list(enumerate(texts)))
    given = []
    monkeypatch.setattr(N, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(N, "lookup", lambda *a, f=N.lookup, **b: given.append(b.get("fits")) or f(*a, **b))
    assert cleaned(spark, texts) == [want[i] for i in range(len(texts))]
    assert given[0] is False


def test_no_join_is_broadcast_by_its_files_bytes(spark, monkeypatch, tmp_path):
    """What was counted not to fit is shuffled, however small Spark takes it to be: files of few bytes, times salts or lists."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.range(1000).select((F.col("id") % 7).alias("k"), "id").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    big, small = t.withColumnRenamed("id", "n"), t.groupBy("k").agg(F.max("id").alias("m")).where("k < 5")
    for how, rows in (("inner", 715), ("left", 1000), ("left_anti", 285)):
        out = N.lookup(big, small, "k", F.col("n"), how=how, fits=False)
        assert out.count() == rows and "Broadcast" not in plan(out)
    d = spark.createDataFrame([(i, f"a\nb\nc\nd\ne\nf\nown {i}") for i in range(9)], "doc_id long, text string")
    few = N.line_dedup(d)
    monkeypatch.setattr(N, "BROADCAST_RUNS", 0)
    many = N.line_dedup(d)
    texts = re.compile("BroadcastHashJoin.* LeftOuter")
    assert texts.search(plan(few)) and not texts.search(plan(many))
    assert sorted(few.collect()) == sorted(many.collect()) and any(r["removed_lines"] for r in many.collect())


def test_what_stands_nowhere_else_stays(spark):
    assert cleaned(spark, ["a\na\na", "p\nq", "q\nr", "p\nq\nr", "one\n\n\ntwo", "three\n\n\nfour"]) == ["a\na\na", "p\nq", "q\nr", "p\nq\nr", "one\n\n\ntwo", "three\n\n\nfour"]


def test_recall_by_length_of_passage(spark):
    """Passages of some lines in three texts each, with other lines around: the share of lines that go from the copies."""
    rows, each = [], 100
    sizes = (2, 3, 4, 6, 10)
    for n in sizes:
        for k in range(each):
            passage = [f"passage {n} {k} line {i}" for i in range(n)]
            rows += ["\n".join([f"own {n} {k} {c} {i}" for i in range(c + 1)] + passage + [f"end {n} {k} {c} {i}" for i in range(3 - c)]) for c in range(3)]
    left = cleaned(spark, rows)
    recall = {}
    for x, n in enumerate(sizes):
        gone = 0
        for i in range(3 * each * x, 3 * each * (x + 1)):
            was, now = rows[i].split("\n"), left[i].split("\n")
            if i % 3 == 0:
                assert was == now
            assert [y for y in was if not y.startswith("passage")] == [y for y in now if not y.startswith("passage")]
            gone += len(was) - len(now)
        recall[n] = gone / (2 * each * n)
    print(recall)
    assert recall[2] >= 0.5 and recall[3] >= 0.85 and recall[4] >= 0.93 and min(recall[6], recall[10]) >= 0.97


def test_runs_whose_bytes_differ_stay(spark, monkeypatch):
    """With line hashes that tell no lines of one length apart."""
    texts = ["aa\nbb", "ax\nbx", "aa\nbb"]
    assert cleaned(spark, texts) == ["aa\nbb", "ax\nbx", ""]
    real = F.xxhash64
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: real(F.length(c[0])) if len(c) == 1 and "slice" not in str(c[0]) else real(*c))
    assert cleaned(spark, texts) == texts


SPEECH = {"en": "the house and the garden with those old windows", "de": "das Haus und der Garten mit alten Fenstern", "fr": "la maison et le jardin avec des vieilles fenêtres"}


def test_language_id(spark):
    rows = [(i, (SPEECH[lang] + " ") * (1 + i % 4), lang, f"h{i % 3}.example.org") for i, lang in enumerate(list(SPEECH) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = L.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    ask = [(i, *r) for i, r in enumerate([(SPEECH["de"], "en", None, None), (SPEECH["fr"], None, "h1.example.org", "org"), ("", "de-AT", "x.de", "de"), (None, None, None, None), ("語言識別 言語判定 " * 20, None, None, None), ("123 456 !!", "fr", None, "fr"), (SPEECH["en"] * 3000, None, None, "de")])]
    got = {r["id"]: r for r in L.identify(spark.createDataFrame(ask, "id long, text string, declared string, host string, suffix string"), ["id"], model).collect()}
    assert [got[i]["language"] for i in (0, 1, 2, 5, 6)] == ["de", "fr", "de", "fr", "en"]
    assert [got[i]["accepted"] for i in range(7)] == [True, True, False, False, False, False, True]
    kept = L.accepted(docs)
    assert kept.count() == len(rows) and kept.columns == docs.columns
    d = data.docs(spark)
    assert L.accepted(d).columns == d.columns
    assert L.accepted(data.nothing(spark)).count() == 0


def test_language_id_against_brute_force(spark):
    """Likelihoods, declarations, suffixes and priors by host and domain, fused row by row."""
    rnd = random.Random(6)
    hosts = ["a.x.de", "b.x.de", "www.y.fr", "z.org", None, "localhost"]
    rows = []
    for i in range(120):
        lang = rnd.choice(list(SPEECH))
        words = SPEECH[lang].split()
        text = rnd.choice((" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))), " ".join(rnd.choice(" ".join(SPEECH.values()).split()) for _ in range(4)), "", None, "12 34", "語言識別 言語判定 " * 20))
        rows.append((i, text, None if text and text[0] == "語" else lang, rnd.choice((lang, lang, "de-AT", "xx", None, " FR")), rnd.choice(hosts), rnd.choice(("de", "fr", "org", None))))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, declared string, host string, suffix string").repartition(3)
    got = {r["doc_id"]: r for r in L.identify(df, ["doc_id"], L.fit(df)).collect()}
    want = brute.identified(brute.language_model([(r[1], r[2]) for r in rows]), [(r[1], *r[3:]) for r in rows], L.SUFFIXES)
    for r, (language, probability, accepted) in zip(rows, want, strict=True):
        g = got[r[0]]
        assert (g["language"], g["accepted"]) == (language, accepted), r
        assert abs(g["probability"] - probability) < 1e-3
    assert len({w[0] for w in want}) == 4 and {w[2] for w in want} == {True, False}


def test_rare_languages_are_known_at_every_size(spark):
    """Few rows among many, and more languages than a fixed number."""
    rare = [(100_000 + i, SPEECH["fr"], "fr", None) for i in range(10)]
    rare += [(200_000 + 6 * k + i, f"tongue{k} speaks{k} words{k}", f"x{k:02}", None) for k in range(70) for i in range(6)]
    often = spark.range(24_000).select(F.col("id").alias("doc_id"), F.lit(SPEECH["en"]).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    model = L.fit(often.union(spark.createDataFrame(rare, "doc_id long, text string, lang string, source string")))
    assert model.languages == sorted(["en", "fr", *(f"x{k:02}" for k in range(70))])
    ask = spark.createDataFrame([(1, SPEECH["fr"], None, None, None)], "id long, text string, declared string, host string, suffix string")
    assert L.identify(ask, ["id"], model).first()["language"] == "fr"


def test_a_language_of_one_row_is_known(spark):
    rows = [(i, SPEECH["en"] + f" {i}", "en", None) for i in range(50)] + [(99, SPEECH["fr"], "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert L.fit(docs).languages == ["en", "fr"] and L.accepted(docs).count() == 51


def test_host_prior_decides_a_short_text(spark):
    """A word that all languages share goes with its host."""
    rows = [(i, SPEECH[lang] + " radio", lang, f"{lang}.example.org") for i, lang in enumerate(list(SPEECH) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = L.fit(docs)
    ask = docs.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    short = spark.createDataFrame([(1000, "radio", None, "fr.example.org", None), (1001, "radio", None, "de.example.org", None)], ask.schema)
    got = {r["doc_id"]: r["language"] for r in L.identify(ask.union(short), ["doc_id"], model).collect()}
    assert (got[1000], got[1001]) == ("fr", "de")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.where("doc_id % 2 = 0"))
    rest = L.of_documents(docs.where("doc_id % 2 = 1")).withColumn("declared", F.lit(None).cast("string"))
    right = L.identify(rest, ["doc_id"], model).join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0]
    assert right > 0.98
