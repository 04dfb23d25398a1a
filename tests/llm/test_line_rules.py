from collections import Counter

import brute
from compare import oracle_connection, oracle_rows, spark_rows
from reelstate.llm import line_rules, queries

SCHEMA = "doc_id long, text string, source string"
COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "n_removed_words", "kept")


def story(i, n=30):
    return " ".join(f"w{i}x{j}" for j in range(n))


def rows():
    notice = "Please accept   our TERMS of use and all that comes with them today or later"
    out = [(i, f"{notice}\n{story(i)}", "a") for i in range(40)]
    out += [(100 + i, f"{notice.lower()}\n{story(100 + i, 2)} one two three four five", "a") for i in range(5)]
    out += [(200 + i, notice + " and\n" + " ".join(f"v{j}" for j in range(12)), "a") for i in range(30)]
    out += [(300 + i, f"{notice}\n{story(300 + i)}", "b") for i in range(8)]
    out += [(400 + i, f"{notice}\n{notice}\nplus {i}", "c") for i in range(12)]
    out += [(500, None, "a"), (501, "", "a"), (502, " \n\t\n ", None), (None, story(1), None),
            (503, story(3) + "\n" + story(3) + "\n" + story(3), "a"), (504, "# $ x\n# $ x\n|", "a"),
            (505, " ".join("ab"[k % 2] for k in range(25)), "a"), (506, "é 日本 語 " * 12, "a"),
            (None, f"{notice}\n{story(7)}", None)]
    return out + [(1, f"{notice}\n{story(1)}", "a")] * 2


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in line_rules.verdicts(df).collect())
    assert got == Counter(brute.line_verdicts(rows()))


def test_the_first_document_keeps_its_lines(spark):
    verdicts = {r.doc_id: r for r in line_rules.verdicts(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert verdicts[0].n_removed_words == 0 and verdicts[2].n_removed_words == 15
    assert verdicts[400].n_removed_words == 0 and verdicts[401].n_removed_words == 30


def test_cleaned_documents(spark):
    df = spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows()],
                               SCHEMA + ", n_chars long, _n_words int")
    got = line_rules.cleaned(df)
    assert got.columns == df.columns
    kept = {r.doc_id for r in line_rules.verdicts(df).where("kept").collect()}
    texts = {}
    for r in got.collect():
        texts.setdefault(r.doc_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert set(texts) == kept
    assert texts[2][0].text == story(2) and texts[0][0].text.startswith("Please accept")
    assert len(texts[1]) == 3


def test_long_text_and_empty_table(spark):
    long = "\n".join(story(i) for i in range(4000))
    df = spark.createDataFrame([(1, long, "a")], SCHEMA)
    assert line_rules.verdicts(df).first().n_words == 120_000
    assert line_rules.verdicts(df.limit(0)).count() == 0
    assert line_rules.cleaned(df.limit(0)).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    got = spark_rows(queries.QUERIES["op3_line_rules"](spark, sf_dir))
    assert got == oracle_rows(oracle_connection(sf_dir), queries.LINE_SQL)
