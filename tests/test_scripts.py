"""Scripts as trees: shapes of trees, modes of the lexer, odd input, and metrics over them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faktum.operators.script_metrics import operator_counts, tree_metrics
from faktum.sources import scripts
from faktum.sources.scripts import comment_bodies, elements, nodes, tokens, tree


def shape(text):
    """The tree as nested (kind or operator, children)."""
    rows = tree(text)
    made = [[f"{r[4]}{':' + r[5] if r[5] else ''}{'=' + r[6] if r[4] in ('identifier', 'number', 'string') else ''}", []] for r in rows]
    for r in rows[1:]:
        made[r[1]][1].append(made[r[0]])
    flat = lambda x: x[0] if not x[1] else f"{x[0]}({' '.join(map(flat, x[1]))})"
    return flat(made[0]).removeprefix("program").removeprefix("(").removesuffix(")")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a + b * c", "statement(binary:+(identifier=a binary:*(identifier=b identifier=c)))"),
        ("a ** b ** c", "statement(binary:**(identifier=a binary:**(identifier=b identifier=c)))"),
        ("a - b - c", "statement(binary:-(binary:-(identifier=a identifier=b) identifier=c))"),
        ("x = y = 1, z", "statement(sequence(assign:=(identifier=x assign:=(identifier=y number=1)) identifier=z))"),
        ("!a && -b", "statement(binary:&&(unary:!(identifier=a) unary:-(identifier=b)))"),
        ("a ? b : c ? d : e", "statement(choice(identifier=a identifier=b choice(identifier=c identifier=d identifier=e)))"),
        ("f(a, (b, c))", "statement(call(identifier=f identifier=a group(sequence(identifier=b identifier=c))))"),
        ("a / b / c", "statement(binary:/(binary:/(identifier=a identifier=b) identifier=c))"),
        ("a = /b/.test(c)", "statement(assign:=(identifier=a call(member:.(regex) identifier=c)))"),
        ("`a${`b${1}`}`", "statement(template(template(number=1)))"),
        ("({a, b: 2})", "statement(group(object(identifier=a pair(identifier=b number=2))))"),
        ("for (const x of y) z()", "loop:for(head(declaration(identifier=x identifier=y)) statement(call(identifier=z)))"),
    ],
)
def test_trees(text, want):
    assert shape(text) == want


def test_modes_of_the_lexer():
    text = 'var t = "</p> // no"; /* yes */ r = /"\\/[/"]/g; s = `// no ${a /* two */ + "}"} /* no */`; // three'
    assert [x for k, x, _ in tokens(text) if k == "comment"] == ["/* yes */", "/* two */", "// three"]
    assert [x for k, x, _ in tokens(text) if k == "regex"] == ['/"\\/[/"]/g']
    assert [x for k, x, _ in tokens("a = b / c / d; (e) / f / g; return /h/") if k == "regex"] == ["/h/"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 (){}[]`$'\"/\\*+-=>,;:.?\n!", max_size=60))
def test_any_text_gives_a_tree(text):
    """Tokens are the text but for white space; intervals nest; every node lies inside its parent."""
    found = tokens(text)
    at = 0
    for _, own, start in found:
        assert text[at:start].strip() == "" and text[start : start + len(own)] == own
        at = start + len(own)
    assert text[at:].strip() == ""
    rows = tree(text)
    for number, (node, parent, last, depth, *_) in enumerate(rows):
        assert node == number <= last
        if parent >= 0:
            assert parent < node and last <= rows[parent][2] and depth == rows[parent][3] + 1
    assert all(sum(x[1] == r[0] for x in rows) == r[7] for r in rows)


def test_deep_nesting_is_capped():
    rows = tree("(" * 5000 + "1" + ")" * 5000)
    assert any(r[4] == "capped" for r in rows) and max(r[3] for r in rows) <= scripts.DEPTH + 2
    assert len(tree("+".join(["a"] * 20000))) == 40001


def test_elements(spark):
    html = "<p><!-- <script>no()</script> --><SCRIPT src='x'>a = '</p><!-- x -->';</SCRIPT\n><style>b{}</style><script>open"
    got = elements(spark.createDataFrame([(1, html), (2, None), (3, "<p>plain")], "id int, html string"), "id", "html").orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(1, 0, "comment", " <script>no()</script> "), (1, 1, "script", "a = '</p><!-- x -->';"), (1, 2, "style", "b{}"), (1, 3, "script", "open")]


def test_metrics(spark):
    texts = {
        1: "var a = [1, 2, 3], b = ['x', 2]; (1, 2); p.q['r'].s(); p.q.r; eval(x)(y); a ^= k[0] % 2; do { if (c != c) break } while (1)",
        2: "function id(v) { return v } function s() { return 'x' } const t = () => `a`, u = () => `a${b}`; let n = function () { /* only */ return null }",
        3: "",
        4: None,
    }
    frame = nodes(spark.createDataFrame(list(texts.items()), "id int, body string"), ["id"], "body")
    got = {r.id: r.asDict() for r in tree_metrics(frame, ["id"]).collect()}
    one = {"call_count": 3, "member_depth_max": 4, "array_literal_max_length": 3, "numeric_array_max_length": 3, "bind_count": 3, "member_count": 3, "sequence_count": 1, "numeric_sequence_max_length": 2, "self_compare_count": None, "infinite_loop_count": 1}
    assert {k: got[1][k] for k in one} == one
    two = {"identity_function_count": 1, "string_return_function_count": 2, "const_return_function_count": 2, "string_return_function_ratio": 0.4}
    assert {k: got[2][k] for k in two} == two
    assert got[3]["node_count"] == got[4]["node_count"] == 1
    ops = {(r.id, r.op): r.n for r in operator_counts(frame, ["id"]).collect()}
    assert ops == {(1, "xor"): 1, (1, "mod"): 1, (1, "ne"): 1}


def test_comments_of_scripts(spark):
    texts = ["// a\n/* b */ 'c // d' /* e", "x = 1", None, "<!-- old\ny"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", comment_bodies(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [[" a", " b ", " "], [], [], [" old"]]


def test_kinds_and_fields_of_nodes(spark):
    """Only what is asked for leaves Python, in batches of whole scripts; `numbers` and `fresh` need no join or distinct count."""
    texts = [f"var a{k} = [1, 2, x]; f(x.y.z, x.y, '{k}');" * (k % 5) for k in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(2)
    rows = [(i, *x) for i, t in enumerate(texts) for x in tree(t)]
    got = nodes(frame, ["id"], "body", ["name"], ("string",))
    assert got.columns == ["id", "name"] and sorted(map(tuple, got.collect())) == sorted((r[0], r[7]) for r in rows if r[5] == "string")
    every = {(r.id, r.node): r for r in nodes(frame, ["id"], "body").collect()}
    assert {(*k, r.kind, r.numbers) for k, r in every.items()} == {(r[0], r[1], r[5], sum(x[0] == r[0] and x[2] == r[1] and x[5] == "number" for x in rows)) for r in rows}
    assert sum(r.fresh for r in every.values() if r.kind == "identifier") == len({(r[0], r[7]) for r in rows if r[5] == "identifier"})
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(tree_metrics(nodes(frame, ["id"], "body"), ["id"])) + plan(operator_counts(nodes(frame, ["id"], "body"), ["id"]))


def test_comments_in_one_pass_equal_tokens():
    texts = ["// a\n/* b */ 'c // d' /* e", "a = b / c; // x", "`c${1}` // y", "`c${f(`//`)}` /* z */", "/[/]*/ // q", "x = `//", '"/* no */" <!-- old', "`\\`${n.m }//` // w"]
    for text in texts:
        assert scripts.comments_of(text) == [x for k, x, _ in tokens(text) if k == "comment"], text


def test_pages_of_orders_are_dealt_over_all_tasks(spark):
    """What is made of orders is far larger than their files, so Spark's partitions by bytes would be one or two."""
    from faktum.queries_scripts import order_pages

    made = order_pages(spark, "/root/testdata/sf0.01")
    assert len([n for n in made.groupBy(F.spark_partition_id()).count().collect() if n["count"] > 1000]) == spark.sparkContext.defaultParallelism


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("a b1 o12 5 0x1F 5x1 1e5 .5 , ; ; ; ( ) [ ] { } `a${b1}c9` ${ /* // \n ' \"a1\" 'b22' / /a[/]1/g class 5class function(q1) return => = + ** ! ? : . var let if for(;;) else case of new null é5 5é 1_0 $1 ...".split(" ")), max_size=40))
def test_names_are_those_of_the_tree(parts):
    """Whatever is kept of known statements and scripts, and however they are cut."""
    for text in ("".join(parts), " ".join(parts)):
        rows = tree(text)
        for kind in ("identifier", "string"):
            want = [x[6] for x in rows if x[4] == kind and x[6] is not None]
            assert scripts.names_of(text, kind) == {x: want.count(x) for x in want}


def test_scripts_that_differ_by_numbers_share_their_trees(spark, monkeypatch):
    """A statement is parsed once, whatever its numbers are; names come out with theirs."""
    read = []
    monkeypatch.setattr(scripts, "tree", lambda text: read.append(text) or tree(text))
    for k in range(500):
        text = f"/* {k} */ var o{k} = [{k}, 7];\nf(o{k}.length, 'a{k} b', \"{k}\");\n" + "a += 1;\n" * (k % 9)
        assert scripts.names_of(text, "identifier") == {"o%d" % k: 2, "f": 1, **({"a": k % 9} if k % 9 else {})}
    assert len(read) <= 8
    own = scripts.names(spark.createDataFrame([(1, "x1; x1; y"), (2, None)], "id long, body string"), ["id"], "body", "identifier")
    assert sorted(map(tuple, own.collect())) == [(1, "x1", 2), (1, "y", 1)]


def test_plain_comments_are_those_of_the_lexer(spark):
    """Spark's expressions find the same comments, or leave the script to the lexer; long pieces need no stack."""
    texts = ["a /* b */ + c // d\n<!-- e\nf", "/* open", "/*/", "'/* no */' + \"// no\" // yes", "`// no ${a.b} /* no */` /* yes */", "'\\'// no' // yes\n'open // no\n// yes", "a / b // lexer", "`${a + b}` // lexer", "", "'" + "\\x" * 50_000 + "' // yes", "/*" + "* /" * 50_000 + "*/ // \u00e9"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, body string").select("k", scripts.plain_comments(F.col("body")).alias("plain"), comment_bodies(F.col("body")).alias("lexed"))
    for k, plain, lexed in df.collect():
        assert (plain is None) == (k in (6, 7)) and (plain is None or plain == lexed), texts[k][:50]


def test_line_count(spark):
    from faktum.functions.text import line_count, lines

    texts = ["", "a", "a\n", "\n", "\n\n", "a\r\nb", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(line_count(F.col("t")).alias("n"), F.size(lines(F.col("t"))).alias("want"))
    assert all(r.n == r.want for r in df.collect()) and df.schema["n"].dataType == df.schema["want"].dataType


def test_pages_of_comments_are_read_once(spark):
    """cmt_pages makes and reads its pages once: each table is scanned once."""
    from faktum.queries import QUERIES

    plan = QUERIES["cmt_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.strip(" :+-").startswith("Relation ") for x in plan.splitlines()) == 3


#: Statements that cuts, numbers and comments could go wrong in.
_STATEMENTS = [
    "var o12 = [3, 4, 3];", "f(x.y.z, 12);", "b = b ^ (k % 3);", "let s = 'a' + \"b\" + 7 + 'c';", "if (o1 === o12) g();", "if (o12 === o12) for (;;) g();", "while(1) x();", "while (2) y();", "while(1===1);", "else z;", "/* c 12; */", "// x 5;\n", "<!-- y\n",
    "var h = function (q) { return q; }, e = () => \"1-X\";", "class A { m(a) { return a } }", "`u${a+1}`;", "`t${1}`;", "/re;x/g.test(a);", "a['1.5'].b;", "0x1F + 0x2F;", "12 == 12px;", "(a/*1*/) == (a/*2*/);", "x ? y ; z", ")", "(", "}", "'un\n", "return", "1, 2, 3;", "10 == 10;", "a1b2 == a1b3;", "switch (a) { case 1: b; default: c }", "a.b.c(1, 2);",
]


def _texts(n: int) -> list[str]:
    import random

    rand = random.Random(7)
    return ["", "1"] + ["".join(rand.choice(_STATEMENTS) + rand.choice(["", "\n", " "]) for _ in range(rand.randint(1, 8))) for _ in range(n)]


def test_patterns_of_statements_are_those_of_scripts(spark, monkeypatch):
    """Counts of statements add up to those of the scripts' nodes, and known statements are not read again."""
    from faktum.operators import script_sums
    from faktum.operators.twigs import match_all
    from faktum.sources import scripts

    patterns = {"xor": "binary:^//binary:%", "names": "declaration/declare[function[params/identifier]]//return/identifier", "sums": "declare/binary:+[.//string]", "calls": "statement//call/identifier", "bad": "a["}
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(_texts(60))], "id int, body string")
    rows = lambda df: sorted(map(tuple, df.select("pattern", "id", "n", "error").collect()), key=repr)
    assert rows(script_sums.match_all(frame, ["id"], "body", patterns)) == rows(match_all(scripts.nodes(frame, ["id"], "body"), ["id"], patterns))
    read = []
    monkeypatch.setattr(script_sums, "tree", lambda text: read.append(text) or scripts.tree(text))
    own = script_sums._operators()
    for k in range(2, 500):
        text = f"// order {k}\nvar o{k} = [{k}, {k + 7}];\nf(o{k}, {k} + 1);"
        assert own(text)[0] == len(tree(text))
    assert len(read) == 3


def test_metrics_of_statements_are_those_of_trees(spark):
    """Sums and maxima over statements are those over all nodes, and no node goes through a shuffle."""
    from faktum.operators import script_sums

    frame = spark.createDataFrame([(k, x) for k, x in enumerate(_texts(150))], "id int, body string")
    got, want = script_sums.tree_metrics(frame, ["id"], "body"), tree_metrics(nodes(frame, ["id"], "body"), ["id"])
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_operators_of_statements_are_those_of_trees(spark):
    from faktum.operators import script_sums

    frame = spark.createDataFrame([(k, x) for k, x in enumerate(_texts(150))], "id int, body string")
    got, want = script_sums.operator_counts(frame, ["id"], "body"), operator_counts(nodes(frame, ["id"], "body"), ["id"])
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
