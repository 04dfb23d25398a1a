import duckdb
import pytest

from compare import oracle_rows, spark_rows
from reelstate.llm import queries, quotes

THREE = ("The first paragraph goes on\nfor two lines.\n\nThe second one, which is\nlonger, goes on for\nthree lines.\n\n"
         "The third is short.")
#: Two of three paragraphs in other line breaks; a reply above its quote, quoted again in other line breaks.
WRAPPED = [
    (7, 0, "user", THREE),
    (7, 1, "assistant", "> The first paragraph goes\n> on for two lines.\n>\n> The third\n> is short.\nI agree, as far\nas it goes."),
    (7, 2, "user", "My answer is on top and\nhas two lines.\n\nOn Tuesday, Y wrote:\n> I agree, as far\n> as it goes."),
    (7, 3, "assistant", "> My answer is on top\n> and has two lines.\n>\n> On Tuesday, Y wrote:\n>> I agree,\n>> as far as it goes.\nDone."),
    (7, 4, "user", "> Not said, and\n> by nobody.\n> \n> Done.\n> The second one, which is\nlast"),
]
A = "Hello there, all of you.\n\nThe second paragraph has\ntwo lines of text."
MESSAGES = [
    (1, 0, "user", A),
    (1, 1, "assistant", "On Monday, X wrote:\n> Hello there, all of you.\n\nGood day to you."),
    (1, 2, "user", "> > Hello  THERE, all of you.\n>\n> Good day to you.\nFine.\n\n\n\nBye."),
    (1, 3, "assistant", ">The second paragraph has\n>two lines of text.\nYes.\n> Fine.\nNo.\n"),
    (1, 4, "user", "> Good day to you.\n> something nobody said\nWell."),
    (1, 5, "user", "> Not said by anyone.\nOh."),
    (1, 6, "user", "> > > Hello there, all of you.\n> > not said\ndeep"),
    (1, 7, "user", "> Yes.\nlast"),
    (2, 0, "user", "> Hello there, all of you.\nIn another conversation."),
    (2, 1, "user", None), (2, 2, "user", ""), (2, 3, None, "  no quotes \n"),
    (2, 3, "user", "In another conversation.\n> In another conversation."),
    (2, 3, "user", "In another conversation.\n> In another conversation."),
    (2, 4, "user", "X wrote:\nnothing"), (2, 5, "user", "\x01\n> \x01 a\n>b \n>\n\n>>c"),
    (None, 1, "user", "a"), (None, 2, "user", "> a\nb"), (3, None, "user", "> a"), (3, 1, "user", "a"), *WRAPPED,
]
SCHEMA = "conv_id long, turn long, role string, text string"


def by_turn(rows):
    return {(r["conv_id"], r["turn"]): r for r in rows}


@pytest.fixture(scope="module")
def found(spark):
    return by_turn(quotes.linked(spark.createDataFrame(MESSAGES, SCHEMA)).collect())


def test_parents_and_threads(found):
    links = {k[1]: (r["reply_to"], r["thread"], r["depth"]) for k, r in found.items() if k[0] == 1}
    assert links == {0: (None, 0, 0), 1: (0, 0, 1), 2: (1, 0, 2), 3: (0, 0, 1), 4: (1, 0, 2),
                     5: (None, 5, 0), 6: (0, 0, 1), 7: (3, 0, 2)}


def brute(messages):
    """Whom each message answers, in plain Python: passages, else paragraphs, else lines."""
    import re

    def flat(text):
        return " ".join(text.split()).lower()

    def cut(text):
        rows = [(re.match(r"[ \t]*((?:>[ \t]*)*)", x)[1].count(">"), re.sub(r"^[ \t]*((?:>[ \t]*)+)", "", x))
                for x in (text or "").split("\n")]
        for i, (level, body) in enumerate(rows[:-1]):
            if re.search(r"(?i)^[ \t]*(on .* wrote|.* wrote|-+ *original message *-+)[ \t]*:?[ \t]*$", body) and (
                    rows[i + 1][0] > level):
                rows[i] = (-1, body)
        found = []
        for level, body in rows:
            if found and found[-1][0] == level:
                found[-1][1].append(body)
            else:
                found.append((level, [body]))
        return [(level, "\n".join(bodies)) for level, bodies in found]

    said = {}
    for conv, turn, _, text in messages:
        own = [t for level, t in cut(text) if level == 0]
        parts = ["\n".join(own), *own, *[p for t in own for p in re.split(r"\n\s*\n", t)],
                 *[x for t in own for x in t.split("\n")]]
        for part in parts:
            if flat(part):
                said.setdefault((conv, flat(part)), turn)

    out = {}
    for conv, turn, _, text in messages:
        votes, n = {}, 0

        def vote(level, part):
            nonlocal n
            at = said.get((conv, flat(part)))
            if at is None or at >= turn:
                return False
            votes[-level, at] = votes.get((-level, at), 0) + len(flat(part))
            n += 1
            return True

        for level, passage in cut(text):
            if level > 0 and flat(passage) and not vote(level, passage):
                for paragraph in re.split(r"\n\s*\n", passage):
                    if flat(paragraph) and not vote(level, paragraph):
                        for x in paragraph.split("\n"):
                            vote(level, x)
        best = max(((level, chars, at) for (level, at), chars in votes.items()), default=None)
        out[conv, turn] = (best and best[2], n)
    return out


def test_rewrapped_partial_quotes(found):
    want = brute(WRAPPED)
    assert {k: (found[k]["reply_to"], found[k]["n_linked"]) for k in want} == want
    assert want == {(7, 0): (None, 0), (7, 1): (0, 2), (7, 2): (1, 1), (7, 3): (2, 2), (7, 4): (0, 2)}
    assert [found[7, n]["thread"] for n in range(5)] == [0] * 5 and found[7, 3]["depth"] == 3


def test_own_text(found):
    assert found[1, 0]["own_text"] == A
    assert found[1, 1]["own_text"] == "Good day to you."
    assert found[1, 2]["own_text"] == "Fine.\n\nBye."
    assert found[1, 2]["max_level"] == 2
    assert found[2, 1]["own_text"] == ""
    assert found[2, 4]["own_text"] == "X wrote:\nnothing"


def test_incomplete_rows_link_to_none(found):
    assert found[None, 2]["reply_to"] is None and found[None, 2]["own_text"] == "b"
    assert found[3, None]["reply_to"] is None


def test_order_puts_answers_after_their_originals(spark):
    rows = quotes.reply_ordered(quotes.linked(spark.createDataFrame(MESSAGES, SCHEMA))).collect()
    seen = set()
    for row in rows:
        assert row["reply_to"] is None or (row["conv_id"], row["reply_to"]) in seen
        seen.add((row["conv_id"], row["turn"]))


def test_long_chains(spark):
    rows = [(1, 0, "user", "line 0")] + [
        (1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 70)]
    got = by_turn(quotes.linked(spark.createDataFrame(rows, SCHEMA)).collect())
    assert all(got[1, i]["depth"] == i and got[1, i]["thread"] == 0 for i in range(70))


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", level long, thread string, _lines int")
    assert quotes.linked(empty).count() == 0
    odd = spark.createDataFrame([(*row, 1, "x", 2) for row in MESSAGES],
                                SCHEMA + ", level long, thread string, _lines int")
    assert quotes.linked(odd).count() == len(MESSAGES)


def test_query_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(MESSAGES, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    connection = duckdb.connect()
    connection.execute("CREATE VIEW conversations AS SELECT * FROM "
                       f"read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = spark_rows(queries.QUERIES["op1_quote_linking"](spark, str(tmp_path)))
    assert got == oracle_rows(connection, queries.QUOTE_SQL)
