import pytest

from veritrove.llm.markup import classify, clean, clean_documents, convert

COMMON = frozenset("the of and to in a is that for it was on are as with be by at from or not this".split())

PLAIN = [
    "Ticket #418 covers C# at 5 * 3 * 2, ~13 % of it, and costs rose from $40 to $60 in R&D and Q&A;", "Write to <min_score@relay.example> or https://a.example/x_y_z?b=1&c=2", "- item\n* item\n1. item\n(2) item\no item", "[Page 1]\ntext\n\n[Page 2]",
    '[["a", 1], {"b": [[1, 2], [3]]}]', "Copies lie under D:\\section\\table and D:\\item\\log", "Replace {page_count} by <page>, see [30] and {name}", "p95 < 250 ms while errors > 2 percent", "#tag #other", "a,b,c\n1,2,3", "<|endoftext|> was typed", "snake_case_name and __init", "5'' wide and 6'' high",
    "a | b | c\n1 | 2 | 3", "-----\n+++++\n=====", "x=1e-9, 2 ** 3 ** 4", "it's 'quoted' and ``odd",
]
MARKED = {
    "html": ["a<br>b", "</div>", "x &nbsp; y", "&#8212;", "<!-- note -->", "<P class='x'>t</P>", "<table><tr><td>1</td></tr></table>", "&#x2014;"],
    "markdown": ["# Title", "## Title ##", "a **b c** d", "a __b__ d", "*and the*", "`code`", "[t](http://x)", "![i](f.png)", "[t][5]", "x [^3]", "```py\nx = 1\n```", "- [ ] todo", "Title\n=====", "~~gone~~", "| a | b |\n|---|---|\n| 1 | 2 |", "> quoted text"],
    "wiki": ["[[link]]", "see [[a|b c]]", "{{cite|x}}", "''it''", "'''bold'''", "== Head ==", "{| class=x\n! a !! b\n|-\n| 1 || 2\n|}"],
    "latex": ["\\emph{x}", "a \\cite{n1}", "\\begin{itemize}\n\\item a\n\\end{itemize}", "$\\alpha_1 \\le b$", "\\(x\\)", "\\[x\\]", "$$x$$", "\\section*{A}", "max\\_pages", "\\ref{sec:a}"],
}


@pytest.mark.parametrize("text", PLAIN)
def test_no_markup(text):
    assert convert(text) == (text, [])


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in MARKED.items() for t in ts])
def test_markup(kind, text):
    assert convert(text)[1] == [kind]
    assert convert(f"Some prose before.\n\n{text}\n\nSome after.")[1] == [kind]


def test_markup_of_dashes_only():
    assert convert("Title\n-----") == ("\n\n# Title\n\n", ["markdown"])
    assert clean("Title\r\n-----\r\nSome prose after.", COMMON) == ("# Title\n\nSome prose after.", ["markdown"], 0)
    assert convert("-----") == ("-----", []) and convert("a --- b\n--") == ("a --- b\n--", [])


def test_long_and_triple_marks():
    long = "the letters are read\nin the morning " * 40 + "end"
    for mark in ("***", "___", "**", "__", "*", "_", "~~"):
        assert convert(f"a {mark}{long}{mark} b") == (f"a {long} b", ["markdown"])
        assert convert(f"{mark}x{mark}") == ("x", ["markdown"])
        assert convert(f"a {mark}b c\n \nd e{mark} f")[1] == []
    assert convert("*** and ___ and * * *")[1] == [] and convert("a***b***c ___")[1] == []


def test_structure_is_kept():
    source = "<h1>Head</h1><p>One &amp; two</p><ul><li>a</li><li>b</li></ul><pre><code>x &lt; 1\n  y</code></pre><table><tr><td>1</td><td>2</td></tr>\n<tr><td>3</td><td>4</td></tr></table>"
    text, kinds, dropped = clean(source, COMMON)
    assert kinds == ["html"] and dropped == 0
    assert "# Head" in text and "One & two" in text and "- a\n- b" in text and "    x < 1\n      y" in text and "1 | 2\n3 | 4" in text and "<" not in text.replace("x < 1", "")
    text, kinds, _ = clean("## Title ##\n\nSome **bold** `x_y` [link](http://a.example).\n\n```\n**kept** <b>\n```\n\n- [x] done", COMMON)
    assert kinds == ["markdown"] and text == "## Title\n\nSome bold x_y link.\n\n    **kept** <b>\n\n- done"
    text, kinds, _ = clean("\\section{A}\n\nThe value \\textbf{is \\emph{x}} of $\\frac{a}{b}$.\n\n\\begin{equation}\n\\sum_i x_i\n\\end{equation}\n\n\\begin{itemize}\n\\item p\n\\item q\n\\end{itemize}", COMMON)
    assert kinds == ["latex"] and text == "## A\n\nThe value is x of \\frac{a}{b}.\n\n\\sum_i x_i\n\n- p\n- q"
    text, kinds, _ = clean("== Head ==\n\n'''Bold''' and [[target|shown]] {{stale|kept}}\n\n{| class=x\n! a !! b\n|-\n| 1 || 2\n|}", COMMON)
    assert kinds == ["wiki"] and text == "## Head\n\nBold and shown kept\n\na | b\n1 | 2"


def test_blocks():
    prose = "It is the custom of the house that the letters are read in the morning and that the answers are written by noon, as it was in the days of the founder and is to this day, for that is how it is done in the house and at the gate of it."
    menu = "\ue010Home\ue011 \ue010About us\ue011 \ue010Contact\ue011"
    assert classify([prose, "Short line", menu, "Tiny"], COMMON) == ["content", "content", "rest", "rest"]
    assert classify(["Alone"], COMMON) == ["content"]


def test_linked_structure_is_kept():
    prose = "It is the custom of the house that the letters are read in the morning and that the answers are written by noon, as it was in the days of the founder and is to this day, for that is how it is done in the house and at the gate of it."
    text, kinds, dropped = clean(f"{prose}\n\n* [[first page]]\n* [[second page]]\n* [[third page]]", COMMON)
    assert kinds == ["wiki"] and dropped == 0 and text == f"{prose}\n\n* first page\n* second page\n* third page"
    source = f"== [[Linked head]] ==\n\n[[only linked words]]\n\n* [[a list]]\n* [[by links]]\n\n{prose}\n\n[t](http://x.example) | [u](http://y.example)\n--- | ---\n[v](http://x.example) | [w](http://y.example)\n\n```\nwget https://a.example/long/path/of/a/file.txt\n```"
    text, _, dropped = clean(source, COMMON)
    assert dropped == 1 and text == f"## Linked head\n\n* a list\n* by links\n\n{prose}\n\nt | u\n\nv | w\n\n    wget https://a.example/long/path/of/a/file.txt"
    menu = "<nav><h2>Menu</h2><ul><li><a href='/'>Home</a></li><li><a href='/us'>About us</a></li></ul></nav>"
    bar = "<a href='/'>Home</a> | <a href='/us'>About us</a> | <a href='/c'>Contact</a>"
    text, _, dropped = clean(f"{menu}<p>{prose}</p><p>{bar}</p>", COMMON)
    assert text == prose and dropped > 1
    assert classify(["# Head", "- a plain item\n- another", "\ue010Home\ue011 \ue010About us\ue011"], COMMON) == ["content", "content", "rest"]


def test_documents(frame, common, spark):
    texts = ["**x**", None, "", "plain", "<b>" + "word " * 50_000 + "</b>", "**x**"]
    got = {r["doc_id"]: r for r in clean_documents(frame(texts), common).collect()}
    assert got[1]["text"] == "x" and got[1]["markup"] == ["markdown"] and got[2]["text"] is None and got[2]["markup"] == [] and got[3]["text"] == "" and got[4]["text"] == "plain"
    assert got[5]["markup"] == ["html"] and len(got[5]["text"]) == 249_999 and got[6]["text"] == "x"
    assert clean_documents(frame([]), common).count() == 0
    with pytest.raises(ValueError):
        clean_documents(frame([]), spark.range(10_001).selectExpr("cast(id as string) word"))


PROSE = "It is the custom of the house that the letters are read in the morning and that the answers are written by noon, as it was in the days of the founder and is to this day, for that is how it is done in the house."


def test_links_of_a_text_without_markup_go():
    menu = "https://a.example/home https://a.example/us https://a.example/contact"
    assert clean(f"{menu}\n\n{PROSE}\n \n- https://a.example/x\n- https://a.example/y\n\n{PROSE}", COMMON) == (f"{PROSE}\n\n- https://a.example/x\n- https://a.example/y\n\n{PROSE}", [], 1)
    assert clean(f"{PROSE}\n\nSource: https://a.example/x", COMMON)[2] == 0
    assert clean(f"  {PROSE}\r\n\r\n\r\n See https://a.example/x for it. ", COMMON) == (f"  {PROSE}\r\n\r\n\r\n See https://a.example/x for it. ", [], 0)


def test_nesting_of_any_depth():
    deep = "\\emph{" * 9 + "x" + "}" * 9
    assert convert(f"a {deep} b") == ("a x b", ["latex"])
    assert convert("a 0 `b` c")[1] == ["markdown"]
    assert clean("'''''both''''' and ''one '''two''' three''", COMMON)[0] == "both and one two three"


def test_many_blocks_take_linear_time():
    import time

    blocks = ["short one", "Home About", PROSE, "tiny"] * 15_000
    began = time.monotonic()
    labels = classify(blocks, COMMON)
    assert labels[:4] == ["rest", "rest", "content", "content"] and time.monotonic() - began < 20


def test_second_sweep_like_the_definition():
    import random

    pick = random.Random(4)
    kinds = {"content": PROSE, "rest": "Home About us", "short": "short one", "near": "the words of a line that is near " * 3}
    for _ in range(60):
        names = pick.choices(list(kinds), k=12)
        decided = [i for i, x in enumerate(names) if x in ("content", "rest")]
        want = []
        for i, x in enumerate(names):
            if x in ("content", "rest"):
                want.append(x)
                continue
            sides = [max((d for d in decided if d < i), default=None), min((d for d in decided if d > i), default=None)]
            sides = [d for d in sides if d is not None]
            least = min((abs(d - i) for d in sides), default=0)
            near = {names[d] for d in sides if x == "near" or abs(d - i) == least}
            want.append("rest" if near == {"rest"} and x == "short" else "content")
        assert classify([kinds[x] for x in names], COMMON) == want
