import random
import time

from docgrain.functions.html_table import all_tokens, lay_out, read_cells, simple_tokens, table_rows_of
from docgrain.operators.blocks import document_text, html_table_cells


def naive(rows):
    """Grid by marking every covered square."""
    taken, out = set(), []
    for r, cells in enumerate(rows):
        col = 0
        for tag, down, across, text in cells:
            while (r, col) in taken:
                col += 1
            out.append((r, col, down, across, text, tag == "th"))
            taken |= {(r + i, col + j) for i in range(down) for j in range(across)}
            col += across
    return out


def render(rows):
    body = "".join(
        "<tr>"
        + "".join(f'<{t} rowspan="{d}" colspan="{a}">{x}</{t}>' for t, d, a, x in cells)
        + "</tr>"
        for cells in rows
    )
    return f"<table><tbody>{body}</tbody></table>"


def test_random_spans():
    rng = random.Random(7)
    for _ in range(300):
        rows = [
            [
                (rng.choice(["td", "th"]), rng.randint(1, 3), rng.randint(1, 3), f"t{r}.{c}")
                for c in range(rng.randint(0, 4))
            ]
            for r in range(rng.randint(1, 6))
        ]
        assert read_cells(render(rows)) == naive(rows)


def test_both_parsers_agree():
    rng = random.Random(5)
    bits = [
        "<tr>", "</tr>", "<td>", "</td>", '<th colspan="2">', "</th>", '<TD ROWSPAN="2" class="x">', "text ",
        "a &amp; b", "&lt;", "<br>", "<br/>", "<td/>", "<b>", "</b>", "&nbsp;x", "<!-- c -->", "1 < 2", "<td rowspan=2>",
        "<script>var a='<td>';</script>", "&copy", "<td colspan='3'>", "<>", "</ td>",
    ]
    plain = 0
    for _ in range(2000):
        simple = rng.random() < 0.5
        html = "".join(rng.choices(bits[:16] if simple else bits, k=rng.randint(1, 14)))
        tokens = simple_tokens(html)
        if tokens is not None:
            plain += 1
            assert table_rows_of(tokens) == table_rows_of(all_tokens(html)), html
    assert plain > 500


def test_spans_of_any_sign_match_marked_squares():
    rng = random.Random(11)
    for _ in range(500):
        rows = {
            r: [(False, rng.randint(-1, 4), rng.randint(-2, 3), "") for _ in range(rng.randint(0, 5))]
            for r in range(-1, rng.randint(0, 6))
        }
        taken, want = set(), []
        for r in sorted(rows):
            col = 0
            for _, down, across, _ in rows[r]:
                while (r, col) in taken:
                    col += 1
                want.append((r, col))
                taken |= {(i, c) for i in range(r, r + down) for c in range(col, col + across)}
                col += across
        assert [c[:2] for c in lay_out(rows)] == want


def test_a_long_row_and_long_spans_take_linear_time():
    first = "".join('<td rowspan="400">a</td><td>b</td>' for _ in range(10_000))
    html = f"<tr>{first}</tr><tr>{'<td>c</td>' * 10_000}</tr>"
    start = time.perf_counter()
    cells = read_cells(html)
    assert time.perf_counter() - start < 1
    assert [c[1] for c in cells[20_000:]] == list(range(1, 20_000, 2))


def test_edges():
    assert read_cells(None) == [] and read_cells("") == [] and read_cells("<p>x</p>") == []
    assert read_cells('<tr><td rowspan="x">a &amp; b</td></tr>') == [(0, 0, 1, 1, "a & b", None)]
    assert read_cells("<td>early</td><tr><td>a<br/>b</td></tr>") == [
        (-1, 0, 1, 1, "early", False),
        (0, 0, 1, 1, "a\nb", False),
    ]
    huge = read_cells('<tr><td colspan="1000000000">x</td><td>y</td></tr>')
    assert huge[1][1] == 1_000_000_000
    assert read_cells('<tr><td colspan="">x</td><td></td></tr>')[1][1] == 1


def test_table_cells(spark):
    html = '<table><tr><th>h</th></tr><tr><th rowspan="9">r</th><td>v</td></tr></table>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    out = html_table_cells(df, "html", ["id"]).orderBy("cell_ord").collect()
    assert [(r.id, r.row_no, r.col_no, r.column_header, r.row_header) for r in out] == [
        (1, 0, 0, True, False),
        (1, 1, 0, False, True),
        (1, 1, 1, False, False),
    ]
    # The trailing span reaches row 9, but only two rows have cells.
    assert {(r.num_rows, r.num_cols) for r in out} == {(2, 2)}


def test_cells_leave_in_pieces(spark):
    """Large and small tables in one batch, more cells than leave together; keys of any type go along."""
    wide = "<table>" + "<tr><th>k</th><td>v</td></tr>" * 12_000 + "</table>"
    rows = [(1, ["a"], wide), (2, None, None), (None, ["b", None], "<tr><td colspan=\"3\">z</td></tr>"), (4, [], "<p>no table</p>")]
    df = spark.createDataFrame(rows, "id int, tags array<string>, html string").coalesce(1)
    out = html_table_cells(df, "html", ["id", "tags"])
    assert out.groupBy("id", "tags", "num_rows", "num_cols").count().orderBy("id").collect() == [
        (None, ["b", None], 1, 3, 1), (1, ["a"], 12_000, 2, 24_000)
    ]
    assert out.filter("id = 1").selectExpr("min(cell_ord)", "max(cell_ord)", "count(DISTINCT cell_ord)", "count_if(row_header)", "max(col_no)").first() == (
        0, 23_999, 24_000, 11_999, 1
    )
    assert html_table_cells(df.limit(0), "html", ["id"]).count() == 0


def test_document_text(spark):
    ddl = (
        "id int, blocks array<struct<id:string,block_type:string,html:string,markdown:string,"
        "section_hierarchy:map<string,string>>>"
    )
    blocks = [
        ("a", "SectionHeader", "<h1>Head</h1>", None, {"2": "x"}),
        ("b", "ListGroup", "<ul><li>one</li><li>two</li></ul>", None, None),
        ("c", "Table", "<table><tr><td>1</td><td>2</td></tr></table>", None, None),
        ("d", "Picture", "<img alt='p'>", None, None),
        ("e", None, "<p>body</p>", None, None),
    ]
    df = spark.createDataFrame([(1, blocks)], ddl)
    text = document_text(df, "blocks", ["id"]).first().text
    assert text == "## Head\n\n- one\n- two\n\n| 1 | 2 |\n\nbody"
