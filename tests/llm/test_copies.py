import random

from veritrove.llm.copies import copies, copy_counts, dictionary, flattened, letters, rewritten, structure


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["keep_doc_id"], set()).add(r["copy_doc_id"])
    return out


def same(a, b):
    x, y = structure(a), structure(b)
    return letters(a) == letters(b) or (x is not None and y is not None and coded(x) == coded(y))


NUMBERS = {}


def coded(node):
    shape, values = flattened(node)
    return rewritten(shape, [NUMBERS.setdefault(letters(v), len(NUMBERS)) for v in values])


def test_formatting(frame):
    texts = [
        "Hello, World! 42", "HELLO world 42", "hello-world—42\n", "Hello World 43", None, "", " \n", "...", "!?", "Straße", "STRASSE", "world hello 42",
    ]
    assert groups(copies(frame(texts))) == {1: {2, 3}, 10: {11}}


def test_fields_may_change_places():
    assert same('[{"a": 1, "b": "x y"}, {"a": 2, "b": "z"}]', '[{"b":"X Y","a":1},\n{"a":2,"b":"Z"}]')
    assert not same('[{"a": 1, "b": 2}]', '[{"a": 2, "b": 1}]')
    assert not same('[{"a": 1}, {"a": 2}]', '[{"a": 2}, {"a": 1}]')
    assert not same('{"a": [1, 2]}', '{"a": [2, 1]}')
    assert same("a: 1 | b: 2\na: 3 | b: 4", "B: 2|A: 1\nb: 4 ; a: 3".replace(" ; ", "|"))
    assert same("a: 1 | b: 2\na: 3 | b: 4", "b: 2 ; a: 1\nb: 4 ; a: 3")
    assert not same("a: 1 | b: 2\na: 3 | b: 4", "a: 3 | b: 4\na: 1 | b: 2")
    assert same("x,y,z\n1,2,3\n4,5,6", "Z;X;Y\n3;1;2\n6;4;5")
    assert not same("x,y,z\n1,2,3\n4,5,6", "z,x,y\n1,2,3\n4,5,6")
    assert same("| x | y |\n|---|---|\n| 1 | 2 |", "| y | x |\n|---|---|\n| 2 | 1 |")
    assert not same("one list: alpha, beta\ntwo list: gamma, delta", "one list: beta, alpha\ntwo list: delta, gamma")
    assert not same("first line\nsecond line", "second line\nfirst line")
    assert same("name: a\nkind: b\n\nname: c\nkind: d", "kind: b\nname: a\n\nkind: d\nname: c")


def test_fields_of_json_lines_and_of_single_records_may_change_places(frame):
    assert same('{"a": 1, "b": "x y"}\n{"a": 2, "b": "z"}', '{"b":"X Y","a":1}\r\n\n{"b":"Z","a":2}\n')
    assert same('{"a": 1, "b": 2}\n{"a": 3, "b": 4}', '[{"b": 2, "a": 1}, {"b": 4, "a": 3}]')
    assert not same('{"a": 1, "b": 2}\n{"a": 3, "b": 4}', '{"b": 4, "a": 3}\n{"b": 2, "a": 1}')
    assert not same('{"a": 1, "b": 2}\n{"a": 3, "b": 4}', '{"a": 2, "b": 1}\n{"a": 3, "b": 4}')
    assert structure('{"a": 1}\nplain') is None and structure('{"a": 1}\n{"b"') is None and structure('{"a": 1}\n5') is None
    assert same("name: a | kind: b", "kind: b | name: a") and not same("name: a | kind: b", "name: b | kind: a")
    assert same("name: a\nkind: b\nsize: c", "size: c\nname: a\nkind: b") and not same("name: a\nkind: b", "name: b\nkind: a")
    assert not same("step: a\nstep: b", "step: b\nstep: a") and not same("Note: a\nplain", "plain\nNote: a")
    texts = ['{"a": "x", "b": "y"}\n{"a": "z", "b": "w"}', '{"b": "y", "a": "x"}\n{"b": "w", "a": "z"}', "name: a; kind: b", "kind: b; name: a", "id: p\nrole: q", "role: q\nid: p"]
    assert groups(copies(frame(texts))) == {1: {2}, 3: {4}, 5: {6}}


def test_both_relations_join_groups(frame):
    # 1 and 2 share fields, 3 has the letters of 2 but has lost its lines
    texts = ["a: x1 | b: y2 | c: z3", "b: y2 | a: x1 | c: z3", "b y2 a x1 c z3", "unrelated"]
    assert groups(copies(frame(texts, [7, 5, 9, 1]))) == {5: {7, 9}}
    assert sorted(tuple(r) for r in copy_counts(frame(texts, [7, 5, 9, 1])).collect()) == [(1, 1), (5, 3)]


def test_hot_group_and_empty(frame):
    texts = ["same text"] * 400 + [f"text {i}" for i in range(300)]
    random.Random(1).shuffle(texts)
    first = texts.index("same text") + 1
    found = groups(copies(frame(texts)))
    assert list(found) == [first] and len(found[first]) == 399
    assert copies(frame([])).count() == 0
    assert copies(frame(["x", "X"], [None, 3])).count() == 0


def test_dictionary_has_one_integer_per_canonical_value(spark):
    values = ["Ab-c", "abc", "ABC!", "x", "x", "x", "", "--", "y 1", "Y1"]
    found = {r["value"]: (r["id"], r["uses"]) for r in dictionary(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert set(found) == set(values) and found["x"][1] == 3
    assert found["Ab-c"][0] == found["abc"][0] == found["ABC!"][0] and found[""][0] == found["--"][0] and found["y 1"][0] == found["Y1"][0]
    assert {i for i, _ in found.values()} == set(range(4))


def test_long_names_and_deep_structures(frame):
    name = "a very long name of a field that has far more than forty signs in it"
    assert same(f"{name}: x; kind: b", f"kind: b; {name}: x") and not same(f"{name}: x; kind: b", f"kind: x; {name}: b")
    deep = '{"a": ' * 200 + '{"x": 1, "y": 2}' + "}" * 200
    assert same(deep, deep.replace('"x": 1, "y": 2', '"y": 2, "x": 1')) and not same(deep, deep.replace('"x": 1, "y": 2', '"y": 1, "x": 2'))
    assert groups(copies(frame([deep, deep.replace('"x": 1, "y": 2', '"y": 2, "x": 1'), "other"]))) == {1: {2}}


def test_records_of_which_half_share_a_content_and_values(frame):
    pick = random.Random(5)
    texts = []
    for i in range(300):
        fields = ["status: open", "owner: none", "site: here"] if i % 2 else [f"status: {i}", "owner: none", f"site: {i % 7}"]
        pick.shuffle(fields)
        texts.append(" | ".join(fields))
    found = groups(copies(frame(texts)))
    assert found == {2: set(range(4, 301, 2))}
    assert sorted(r["copies"] for r in copy_counts(frame(texts)).collect()) == [1] * 150 + [150]


def test_no_hot_content_is_shuffled(frame, monkeypatch, spark):
    from veritrove.llm import copies as K

    texts = ["one text that half of all documents have"] * 150 + [f"text {i // 2}" for i in range(150)]
    random.Random(2).shuffle(texts)
    want = groups(copies(frame(texts)))
    monkeypatch.setattr(K.hot_join, "__defaults__", (20,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = copies(frame(texts))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1
        assert groups(found) == want and max(map(len, want.values())) == 149
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
