import random

import brute
import duckdb
import pytest

from cohortfold.llm import queries, templates

SF = "/root/testdata/sf0.001"
ITEM = "A farmer has 12 sheep and sells 5 of them to his neighbour Anna for 30 dollars each; how many sheep does the farmer keep after 12 days?"


def leaks(spark, docs, items, **more):
    found = templates.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **more)
    return {(r.doc_id, r.item_id): (r.run_tokens, r.n_slots, r.same_values) for r in found.collect()}


def test_query_finds_every_copied_passage(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs, items = read("documents"), read("benchmark")
    found = {(r.doc_id, r.item_id) for r in templates.find_leaks(docs, items).collect()}
    want = brute.shared_runs([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 13)
    assert want.keys() and set(want) <= found
    assert found == set(want)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{table}.parquet')")
    want = con.sql(queries.ORACLES["op10_decontamination"])
    rows = queries.op10_decontamination(spark, "/root/testdata/sf0.01").select(want.columns).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(want.fetchall())


def test_reparameterised_questions(spark):
    other = ITEM.replace("12", "40").replace("5 ", "7 ").replace("Anna", "Boris").replace("30 dollars", "25 euros")
    mixed = ITEM.replace("12 sheep", "40 sheep")  # 12 stands for 40 once and for 12 once: told by the stretch between
    docs = [(1, f"some words before it. {ITEM} and after"), (2, f"Before. {other} After."), (3, mixed), (4, "A farmer has sheep and sells them"), (5, ITEM.upper())]
    found = leaks(spark, docs, [(9, ITEM)])
    assert found[1, 9][2] is True and found[2, 9][2] is False and found[2, 9][1] >= 5
    assert found[3, 9] == (26, 5, False) and (4, 9) not in found


def test_every_offset_is_found(spark):
    words = [f"q{chr(97 + i)}z" for i in range(14)]
    docs = [(k, " ".join([f"pad{chr(97 + j)}" for j in range(k)] + words)) for k in range(8)]
    assert set(leaks(spark, docs, [(1, " ".join(words))])) == {(k, 1) for k in range(8)}


def test_edges(spark):
    words = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(20))
    long = " ".join(f"l{chr(97 + i % 23)}{chr(97 + i % 19)}" for i in range(100_000)) + " " + words
    assert leaks(spark, [], [(1, words)]) == {} and leaks(spark, [(1, words)], []) == {}
    docs = [(1, None), (2, ""), (3, " \n"), (4, "*** ||| <>"), (5, words), (5, words), (None, words), (6, long), (7, words.replace(" ", "\n\t "))]
    items = [(1, words), (1, words), (2, words), (3, None), (4, ""), (5, "short item"), (None, words)]
    found = leaks(spark, docs, items)
    assert set(found) == {(d, i) for d in (5, 6, 7) for i in (1, 2)} and {v[0] for v in found.values()} == {20}


def test_clashing_columns(spark):
    words = " ".join(f"w{chr(97 + i)}" for i in range(16))
    docs = spark.createDataFrame([(1, words, 5, "x", 3)], "doc_id long, text string, item_id long, hash string, words int")
    items = spark.createDataFrame([(2, words, 7, "y")], "item_id long, text string, doc_id long, item string")
    out = templates.find_leaks(docs, items)
    assert out.columns == ["doc_id", "item_id", "run_tokens", "n_slots", "same_values"]
    assert [tuple(r)[:3] for r in out.collect()] == [(1, 2, 16)]


def test_runs_are_cut_where_slots_disagree(spark):
    mixed = ITEM.replace("12 sheep", "40 sheep")  # 40 stands for 12 up to "after"; from "sheep" on all is verbatim
    found = leaks(spark, [(1, mixed), (2, "A farmer has 40 sheep and sells 5 of them")], [(9, ITEM)])
    assert found == {(1, 9): (26, 5, False)}


def test_second_run_of_an_alignment_is_judged(spark):
    words = lambda c, n: [f"{c}{chr(97 + i)}x" for i in range(n)]
    numbers = "3 3 3 3".split()
    item = words("p", 6) + numbers[:2] + words("q", 8) + ["mid"] + words("r", 14)
    doc = words("p", 6) + ["4", "5"] + words("q", 8) + ["other"] + words("r", 14)
    found = leaks(spark, [(1, " ".join(doc))], [(2, " ".join(item))])
    assert found == {(1, 2): (14, 0, True)}


def test_short_items_are_found_whole(spark):
    items = [(1, "Which gas do plants take in during photosynthesis?"), (2, "What is 7 times 8?"), (3, "A train runs 60 miles in 2 hours; how fast?"), (4, "Paris")]
    docs = [(d, "Pad. " * d + f"{text} And on.") for d, text in enumerate([i for _, i in items] * 2)]
    docs += [(20, "What is 7 times 9?"), (21, "So: a train runs 70 miles in 3 hours; how fast?"), (22, "Which gas do plants take in during the night")]
    found = leaks(spark, docs, items)
    assert set(found) >= {(d, d % 4 + 1) for d in range(7) if d % 4 < 3} and found[0, 1] == (8, 0, True) and found[21, 3] == (10, 4, False)
    assert (3, 4) in found and not {(20, 2), (22, 1)} & set(found)


def test_every_offset_of_a_dense_question_is_found(spark):
    dense = "What is 12 plus 7 minus 3 times 4 plus 9 divided by 2 plus 6?"
    other = "What is 31 plus 8 minus 5 times 2 plus 6 divided by 4 plus 7?"
    table = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"
    docs = [(10 * n + k, "Pad. " * k + f"{text}") for n, text in enumerate((dense, other, table)) for k in range(8)]
    docs += [(99, " ".join(str(n) for n in range(41, 59)))]
    found = leaks(spark, docs, [(1, dense), (2, table)])
    assert set(found) == {(10 * n + k, i) for n, i in ((0, 1), (1, 1), (2, 2)) for k in range(8)}
    assert all(v == (16, 7, d < 10) for (d, i), v in found.items() if i == 1)


def test_names_that_begin_sentences_and_other_case(spark):
    ann = "Ann has 3 apples. Bob has 5 apples. Carl has 7 apples. How many apples do they have in total?"
    other = "Dora has 4 apples. Emil has 6 apples. Fay has 2 apples. How many apples do they have in total?"
    clash = other.replace("Dora", "Emil") + " x"  # one value may stand for two of the item
    quoted = ann.replace("Ann", "\u201cGus").replace("Bob", "(Hal)")
    german = "Der alte Bauer trug am Abend einen Korb voller Birnen durch das Dorf zum Haus seiner Schwester"
    docs = [(1, f"Before. {other} After."), (2, clash), (3, quoted), (4, f"so {ann.lower()}"), (5, german.lower()), (6, f"x {german.upper()}"), (7, "Ann has 3 apples. Bob goes home.")]
    found = leaks(spark, docs, [(1, ann), (2, german), (3, "Where does Anna live?")])
    assert set(found) == {(d, 1) for d in (1, 2, 3, 4)} | {(5, 2), (6, 2)}
    assert found[1, 1][::2] == (20, False) and found[4, 1][::2] == (20, True) and found[5, 2][::2] == (17, True)


def test_query_equals_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    docs, items = [(r.doc_id, r.text) for r in read("documents")], [(r.item_id, r.text) for r in read("benchmark")]
    near = {d for d, _ in brute.shared_runs(docs, items, 8)}  # others share no 8 words with any item
    want = brute.leaks([(d, t) for d, t in docs if d in near], items)
    assert want and leaks(spark, docs, items) == want


def test_template_words_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["Anna", "the", "5", "12.5,", "days", "Days.", "km)", "\u201cGus", "(Hal)", "A", "b", "USA", "$30", "-", "...", "12th", "\u00c9t\u00e9,", "one;", "<num>", "x:", "50%", "\u00bd", "1/2"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = templates._cut(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "i").collect()
    for r in rows:
        assert list(zip(r.words, r.named, r.values)) == brute.template_words(texts[r.i]), texts[r.i]


def test_made_questions_equal_brute_force(spark):
    rng = random.Random(12)
    names, units, verbs = ["Ann", "Bob", "Carl", "Dora", "Emil"], ["km", "days", "kg", "dollars"], ["has", "buys", "sells", "eats"]
    things = "apples pears boxes trains books sheep".split()
    number = lambda: str(rng.randint(2, 60))

    def sentence():
        return rng.choice([
            lambda: f"{rng.choice(names)} {rng.choice(verbs)} {number()} {rng.choice(things)}.",
            lambda: f"Then {rng.choice(names)} {rng.choice(verbs)} {number()} {rng.choice(units)} of {rng.choice(things)} for {rng.choice(names)};",
            lambda: f"What is {number()} plus {number()} minus {number()}?",
            lambda: f"How many {rng.choice(things)} does {rng.choice(names)} keep after {number()} {rng.choice(units)}?",
        ])()

    def changed(text):
        how = rng.randint(0, 5)
        words = text.split()
        if how == 1:  # other numbers, each for one
            other = {w: number() for w in words}
            words = [other[w] if w.isdigit() else w for w in words]
        elif how == 2:  # other names
            other = dict(zip(names, rng.sample(["Gus", "Hal", "Ida", "Jon", "Kim"], 5)))
            words = [other.get(w.strip(".;?"), w) if w.strip(".;?") in other else w for w in words]
        elif how == 3:  # any number at any place
            words = [number() if w.isdigit() and rng.random() < 0.5 else w for w in words]
        elif how == 4:
            words = [w.lower() for w in words]
        elif how == 5 and len(words) > 3:  # a word lost
            words.pop(rng.randrange(len(words)))
        return " ".join(words)

    items = [(i, " ".join(sentence() for _ in range(rng.randint(1, 5)))) for i in range(25)]
    pad = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(rng.randint(0, 6)))
    docs = [(d, f"{pad()} {changed(rng.choice(items)[1])} {pad()} {changed(rng.choice(items)[1])}") for d in range(150)]
    found, sure, most = leaks(spark, docs, items), brute.leaks(docs, items), brute.leaks(docs, items, pure=8)
    assert len(sure) > 150 and set(sure) <= set(found) <= set(most)
    for key, (tokens, _, _) in found.items():
        assert sure.get(key, (0,))[0] <= tokens <= most[key][0]
    assert sum(found[k] == sure.get(k) for k in found) >= 0.95 * len(found)


@pytest.mark.parametrize("short", [[], [(5, True), (11, False)]])
def test_document_windows_are_hashed_by_compiled_code(spark, short):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = templates._doc_windows(templates._cut(docs, "text", "doc_id"), short)._jdf.queryExecution().executedPlan()
        lines = [line for line in plan.toString().splitlines() if "xxhash64" in line]
        assert lines and all("*(" in line and "lambda" not in line for line in lines)
        package = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        stages = getattr(package, "MODULE$").codegenStringSeq(plan)
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000  # beyond, the JVM interprets
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
