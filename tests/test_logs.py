import pytest

from brindle.operators import logs as L


def statuses(spark, parser, log):
    df = spark.createDataFrame([("i-1", log)], "instance_id string, log string")
    return {r.test: r.status for r in L.parse(df, parser).collect()}


P, X, S, E = "PASSED", "FAILED", "SKIPPED", "ERROR"
CASES = [
    ("redis", "[ok]: a test (12 ms)\n[err]: bad one in tests/x.tcl\n[skip]: s\n[ignore]: g", {"a test": P, "bad one": X, "s": S, "g": S}),
    ("jq", "PASS: a\n FAIL: b c", {"a": P, "b c": X}),
    ("micropython", "pass  a.py\nFAIL b.py\nskip c.py", {"a.py": P, "b.py": X, "c.py": S}),
    ("googletest", "1: [       OK ] a.b (0 ms)\n[  FAILED  ] c.d (1 ms)", {"a.b": P, "c.d": X}),
    ("gotest", "--- PASS: T (0.1s)\n    --- FAIL: T/x (0s)\n--- SKIP: U (0s)", {"T": P, "T/x": X, "U": S}),
    ("ant", "  [junit] [PASS] a\n[junit] [ERR] b", {"a": P, "b": X}),
    ("jest", "  ✓ one (3 ms)\n ✕ two\n○ three", {"one": P, "two": X, "three": S}),
    ("jest_json", "[PASSED] a > b\n[FAILED] c", {"a > b": P, "c": X}),
    ("vitest", " ✓ a 5ms\n × b\n ↓ c [skipped]", {"a": P, "b": X, "c": S}),
    ("tap", "ok 1 fine\nnot ok 2 broken", {"fine": P, "broken": X}),
    ("react_pdf", "PASS a.js (12ms)\nFAIL b.js (1.2 s)\nPASS c.js", {"a.js": P, "b.js": X, "c.js": P}),
    ("minitest", "a#b. Thing = 0.1 s = .\nc. X = 0 s = F", {"a#b": P, "c": X}),
    ("cucumber", "features/a ....\nfeatures/b ..F", {"features/a": P, "features/b": X}),
    ("ruby_unit", "test: a:\t.: (0.1)\ntest: b: F\nc: O", {"a": P, "b": X, "c": S}),
    ("rspec", "a b - passed\nc - failed\nd - pending", {"a b": P, "c": X}),
    ("cargo", "test a::b ... ok\ntest c ... FAILED\ntest d ... ignored", {"a::b": P, "c": X}),
    ("marked", "1) first thing \n x\n22) second", {"first thing": X, "second": X}),
    ("pytest", "PASSED a::b\nFAILED c::d - assert 1\nERROR\nXFAIL e", {"a::b": P, "c::d": X, "e": "XFAIL"}),
    ("pytest_options", "PASSED t[/a/b/c.py]\nPASSED u[//x/y]\nFAILED v[z]", {"t[/c.py]": P, "u[//x/y]": P, "v[z]": X}),
    ("pytest_v2", "[32mPASSED a\nb FAILED\n\x1bERROR c", {"a": P, "b": X, "c": E}),
    ("matplotlib", "PASSED t[MouseButton.LEFT]", {"t[1]": P}),
    ("seaborn", "FAILED a::b - x\nc::d PASSED [ 5%]\nPASSED e", {"a::b": X, "c::d": P, "e": P}),
    ("sympy", "___ sympy/a.py:test_x ___\ntest_y ok\ntest_z F\ntest_w E", {"sympy/a.py:test_x": X, "test_y": P, "test_z": X, "test_w": E}),
    ("phpunit", " ✔ early\nSuite One (A\\B)\n ✔ works\n ✘ breaks\nTwo (C)\n ↩ later", {"None > early": P, "Suite One > works": P, "Suite One > breaks": X, "Two > later": S}),
    ("gradle", "a.B > one PASSED\na.B > two\nnoise here\nFAILED\nPASSED\n> Task x FAILED", {"a.B > one": P, "a.B > two": X}),
    ("maven", "+ mvn test -Dtest=A\nBUILD SUCCESS\n+ mvn -Dtest=B -q\n+ mvn -Dtest=C\n[INFO] BUILD FAILURE\nBUILD SUCCESS", {"A": P, "B": X, "C": P}),
    ("maven", "BUILD FAILURE\n-Dtest=A\n-Dtest=B\nBUILD SUCCESS", {"A": P, "B": X}),
    ("django", "a (x) ... ok\nb ... FAIL\nc ... skipped 'no'\nERROR: d (y)\ne ... some output\nok\nf ... System check identified no issues (0 silenced)\nok", {"a (x)": P, "b": X, "c": S, "d": E, "e": P, "f": P}),
    ("calypso", "x ./node_modules/.bin/jest run\n  suite\n    inner\n      ✓ works (3ms)\n      ✕ fails\nTest Suites: 1", {"suite - inner - works": P, "suite - inner - fails": X}),
    ("karma", "x\nStarting browser Chrome\n  outer\n    inner\n      ✔ yes\n      ✖ no\nSUMMARY:\n ✔ 1", {"outer > inner > yes": P, "outer > inner > no": X}),
    ("chart_js", "\x1b[31mChrome 99.0 (Linux x) a b FAILED\nChrome 99.0 (Linux x) fine", {"a b ": X}),
    ("p5js", "noise {\n 9) hidden:\n}\n  1) top\n       inner:\n <b>7) x:</b>", {"top:inner": X}),
    ("doctest", '<doctest><TestCase name="A"><SubCase name="s"><Expression success="true"/></SubCase><SubCase name="t"><Expression success="false"/></SubCase></TestCase></doctest>', {"A > s": P, "A > t": X}),
]


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: CASES[i][0])
def test_parser(spark, i):
    parser, log, want = CASES[i]
    assert statuses(spark, parser, log) == want


def test_names():
    assert L.parser_for("flask") == "pytest" and L.parser_for("sphinx") == "pytest_v2"
    assert L.parser_for("jekyll", "jekyll__jekyll-9141") == "minitest" and L.parser_for("immutable_js", "x-2005") == "jest_json"
    with pytest.raises(ValueError):
        L.parser_for("jekyll", "jekyll__jekyll-1")


def test_last_line_wins_and_nulls(spark):
    df = spark.createDataFrame([("a", "PASS: t\nFAIL: t"), ("b", None)], "instance_id string, log string")
    assert [(r.instance_id, r.test, r.status) for r in L.parse(df, "jq").collect()] == [("a", "t", "FAILED")]


def test_section(spark):
    df = spark.createDataFrame([("x >>S\nbody\n>>E y",), ("no marks",)], "log string")
    assert [r.s for r in df.select(L.section(df.log, ">>S", ">>E").alias("s")).collect()] == ["\nbody\n", None]
