from rollbook.llm.quotes import linked

KIND = "conv_id long, turn long, role string, text string, hash string, level int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 1) for r in rows], KIND)


def by_turn(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


def test_nested_quotes_link_to_their_writers(spark):
    rows = [
        (1, 0, "user", "First line.\nSecond line."),
        (1, 1, "assistant", "> first   LINE.\n\nMy answer."),
        (1, 2, "user", ">> First line.\n> My answer.\nThanks."),
        (1, 3, "assistant", "> Nobody wrote this.\nBye."),
        (1, 4, "user", "> > My answer.\n>>> First line.\nok"),
        (2, 5, "user", "> First line.\nother conversation"),
    ]
    got = by_turn(linked(frame(spark, rows), least_words=1))
    assert {k: v.reply_to for k, v in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 1, (2, 5): None}
    assert {k: (v.n_quoted_lines, v.n_linked_lines, v.depth, v.root) for k, v in got.items()} == {(1, 0): (0, 0, 0, 0), (1, 1): (1, 1, 1, 0), (1, 2): (2, 2, 2, 0), (1, 3): (1, 0, 0, 3), (1, 4): (2, 2, 2, 0), (2, 5): (1, 0, 0, 5)}
    assert [got[1, t].text for t in range(5)] == ["First line.\nSecond line.", "My answer.", "Thanks.", "Bye.", "ok"]


def test_passages_link_whatever_their_line_breaks_and_short_lines_do_not(spark):
    rows = [
        (1, 0, "user", "A first line of some words\nand a second one.\n\nThanks!\nBye"),
        (1, 1, "assistant", "Thanks!\n\n}"),
        (1, 2, "user", "> A first line of some\n> words and a\n>  second one.\nyes"),
        (1, 3, "user", "> and a second one.\nonly a part of the passage"),
        (1, 4, "user", "> Bye\n> nobody wrote this here\ntoo short to link by itself"),
        (1, 5, "user", "> Thanks!\n> Bye\n>\n> }\nboth passages are whole"),
        (1, 6, "user", "> > A first line of some words\n> Thanks!"),
    ]
    got = by_turn(linked(frame(spark, rows)))
    assert {t: (got[1, t].reply_to, got[1, t].n_linked_lines) for t in range(7)} == {0: (None, 0), 1: (None, 0), 2: (0, 3), 3: (0, 1), 4: (None, 0), 5: (0, 3), 6: (1, 2)}


def test_the_latest_writer_before_counts(spark):
    rows = [(1, t, "u", "same line") for t in (0, 3, 200)] + [(1, 2, "u", "> same line"), (1, 100, "u", "> same line\nx"), (1, 500, "u", "> same line\nx"), (1, 59, "u", "> same line"), (1, 60, "u", "> same line")]
    got = by_turn(linked(frame(spark, rows)))
    assert {t: got[1, t].reply_to for t in (2, 59, 60, 100, 500)} == {2: 0, 59: 3, 60: 3, 100: 3, 500: 200}
    assert got[1, 0].reply_to is None


def test_long_chains(spark):
    rows = [(7, t, "u", (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(40)]
    got = by_turn(linked(frame(spark, rows)))
    assert all((got[7, t].reply_to, got[7, t].depth, got[7, t].root) == (t - 1, t, 0) for t in range(1, 40))


def test_odd_rows(spark):
    rows = [(None, 0, "u", "a"), (None, 1, "u", "> a"), (1, None, "u", "> a"), (1, 0, None, None), (1, 1, "u", ""), (1, 2, "u", ">"), (1, 3, "u", "> > \n>>"), (1, 4, "u", "x\n" * 5000), (1, 4, "u", "x\n" * 5000), (1, 5, "u", "\n" * 5000 + "> x\n" + "\n" * 5000), (1, -3, "u", "y"), (1, -2, "u", "> y")]
    got = linked(frame(spark, rows), least_words=1).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[None, 1].reply_to is None and by[1, None].reply_to is None and by[1, 0].text is None and by[1, 1].text == ""
    assert by[1, 2].n_quoted_lines == 0 and by[1, 3].n_quoted_lines == 0 and by[1, 5].reply_to == 4 and by[1, 5].text == "" and by[1, -2].reply_to == -3
    assert linked(frame(spark, [])).collect() == []


def test_only_dataframe_functions(spark):
    plan = linked(frame(spark, [(1, 0, "u", "a"), (1, 1, "u", "> a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
