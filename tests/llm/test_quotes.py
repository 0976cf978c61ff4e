import duckdb
from pyspark.sql import functions as F

from lexweave.llm import quotes
from lexweave.llm.queries import QUOTES_SQL, op10_quotation_linking

ROWS = [
    (1, 0, "user", "How do I read a file?\nIt is large."),
    (1, 1, "assistant", "Use open().\n\nOr use   mmap for large files."),
    (1, 2, "user", "Another topic entirely."),
    (1, 3, "user", "> Or use mmap FOR\n> large files.\nThanks, I will."),
    (1, 4, "assistant", ">> Or use mmap for large files.\n> Thanks, I will.\n\nGood luck.\n"),
    (1, 5, "user", "> Another topic entirely.\nYes?"),
    (1, 6, "user", "> never said\nHm."),
    (1, 1500, "user", "  > > Use open().\n> It is large.\nStill reading."),
    (2, 0, "user", "Use open()."),
    (2, 1, "user", "> Use open()."),
    (2, 2, "user", "> Use open().\nUse open()."),
    (2, 2, "user", "> Use open().\nUse open()."),
    (2, 3, "user", "> Use open().\nx"),
    (3, 0, "user", None),
    (3, 1, None, ""),
    (None, 1, "user", "> a\nb"),
    (3, None, "user", "> a\nb"),
]
SCHEMA = "conv_id long, turn long, role string, text string, position string, lines int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_links_order_and_bare_texts(spark):
    out = quotes.reply_order(frame(spark)).collect()
    assert len(out) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in out}
    assert by[1, 3].parent_turn == 1 and by[1, 3].text == "Thanks, I will."
    assert by[1, 4].parent_turn == 3 and by[1, 4].root_turn == 1 and by[1, 4].text == "Good luck." and by[1, 4].quote_depth == 2
    assert by[1, 5].parent_turn == 2 and by[1, 6].parent_turn is None and by[1, 6].n_quoted == 1
    assert by[1, 1500].parent_turn == 0 and by[1, 1500].n_linked == 2
    order = [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1500, 1, 3, 4, 2, 5, 6]
    assert by[2, 1].text == "" and by[2, 3].parent_turn == 2 and by[2, 3].root_turn == 0
    assert sorted(r.position for r in out if r.conv_id == 2) == [0, 1, 2, 3, 4]
    assert by[None, 1].position is None and by[3, None].position is None and by[3, None].text == "b"


def test_the_sql_says_the_same(spark):
    con = duckdb.connect()
    data = frame(spark).drop("position", "lines").toPandas()
    data["conv_id"], data["turn"] = data["conv_id"].astype("Int64"), data["turn"].astype("Int64")
    con.register("conversations", data)
    want = con.execute(QUOTES_SQL).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r[n] for n in names) for r in quotes.reply_order(frame(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_an_empty_table_and_no_python(spark):
    assert quotes.reply_order(frame(spark, ROWS[:1]).limit(0)).count() == 0
    plan = op10_quotation_linking(spark, "/root/testdata/sf0.001").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_deep_nesting_and_very_long_messages(spark):
    deep = "\n".join(">" * k + f" level {k}" for k in range(1, 400))
    rows = [(1, 0, "user", "level 7\n\nA long one.\n" + "\n".join(f"line {k}" for k in range(30_000))), (1, 1, "assistant", deep), (1, 2, "user", "\n".join(f"> line {k}" for k in range(30_000)) + "\nSeen.")]
    out = {r.turn: r for r in quotes.reply_order(frame(spark, rows)).collect()}
    assert out[1].quote_depth == 399 and out[1].n_quoted == 399 and out[1].n_linked == 1 and out[1].text == ""
    assert out[2].parent_turn == 0 and out[2].text == "Seen." and out[2].n_quoted == 30_000


def test_passages_are_paragraphs_and_lines_of_one_level(spark):
    text = "Own words\nover two lines\n\t\n> first\n> second\n>\n> third\n>> inner\n> fourth\n\x015\x02 odd"
    rows = quotes.passages(quotes.parse(frame(spark, [(1, 0, "u", text)]), "conv_id", "turn", "role", "text")).collect()
    assert sorted((r.level, r.passage) for r in rows) == sorted([(0, "own words over two lines"), (0, "own words"), (0, "over two lines"), (1, "first second"), (1, "first"), (1, "second"), (1, "third"), (1, "fourth"), (2, "inner"), (0, "\x015\x02 odd")])
