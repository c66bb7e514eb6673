"""The expression scan on literal M texts."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from estatelens.catalog import fixed_values as fv
from estatelens.functions import arrays, text
from estatelens.operators import calls


def kinds(rows):
    return [r.connector_kind for r in rows]


def test_pin_endpoint_and_kind(scan):
    (row,), = scan('let Source = AmazonRedshift.Database("host:5439", "prod", [Implementation = "1.0"]) in Source')
    assert (row.connector_kind, row.migration) == ("Amazon Redshift", "odbc_to_adbc:redshift")
    assert (row.implementation, row.endpoint_hint) == ("1.0", "host:5439")
    assert row.is_pinned_odbc and not row.is_pinned_adbc and row.is_migrating


def test_every_catalogued_function_is_found(scan):
    names = [(fn, kind) for kind, fns, _, _ in fv.CONNECTOR_RULES for fn in fns]
    found = scan(*[f'{fn.upper() if i % 2 else fn}("x")' for i, (fn, _) in enumerate(names)])
    assert [kinds(rows) for rows in found] == [[kind] for _, kind in names]


def test_mixed_expression_keeps_order_and_drops_builtins(scan):
    rows, = scan(
        'let a = Snowflake.Databases("s"), b = Sql.Database("q"), c = Table.Combine({a, b}), '
        'd = Excel.Workbook(File.Contents("f")), e = Databricks.Catalogs("d") in Text.Upper(e)'
    )
    assert kinds(rows) == ["Snowflake", "SQL Server", "Excel", "File", "Databricks"]
    assert [r.is_migrating for r in rows] == [True, False, False, False, True]


@pytest.mark.parametrize("m, expected", [
    ('// Snowflake.Databases("x")\nSql.Database("y")', ["SQL Server"]),
    ('/* Snowflake.Databases("x") \n more */ Sql.Database("y")', ["SQL Server"]),
    ('let a = "Snowflake.Databases(""x"")" in Sql.Database("y")', ["SQL Server"]),
    ('Web.Contents("https://host/a//b") & Snowflake.Databases("x")', ["Web", "Snowflake"]),
    ('/* never closed Snowflake.Databases("x")', []),
    ('"never closed Snowflake.Databases(x)', []),
    ('"a /* b" & Snowflake.Databases("x") & "*/"', ["Snowflake"]),
    ('a / b / Snowflake.Databases ("x")', ["Snowflake"]),
    ('SomeHelper.Get("x")', ["SomeHelper"]),
    ('1Snowflake.Databases("x")', []),
    ('Snowflake . Databases("x")', []),
    ("", []),
    (None, []),
])
def test_traps(scan, m, expected):
    rows, = scan(m)
    assert kinds(rows) == expected


def test_later_pin_does_not_leak_and_nested_pin_does(scan):
    plain, nested = scan(
        'let a = Snowflake.Databases("a"), b = AmazonRedshift.Database("b", [Implementation="2.0"]) in a',
        'Snowflake.Databases(Helper.Url("u", [Implementation="1.0"]))',
    )
    assert [r.implementation for r in plain] == [None, "2.0"]
    assert [(r.m_function, r.implementation) for r in nested] == [("Snowflake.Databases", "1.0"), ("Helper.Url", "1.0")]


def test_parenthesis_in_string_does_not_close_the_call(scan):
    (row,), = scan('Impala.Database("a) b", [implementation = \'1.0\'])')
    assert (row.endpoint_hint, row.implementation) == ("a) b", "1.0")


def test_without_positional_string_the_option_value_is_the_endpoint(scan):
    (row,), = scan('Snowflake.Databases(Server, [Implementation = "1.0"])')
    assert row.endpoint_hint == "1.0"


@pytest.mark.parametrize("m, flagged", [
    ('Odbc.DataSource("dsn=x")', [True]),
    ('OleDb.Query("x", "y")', [True]),
    ('Snowflake.Databases("x", Odbc.Query("y"))', [True, True]),
    ('Sql.Database("Driver={SQL Server};x")', [True]),
    ('Sql.Database("x") & Odbc.Query("y")', [False, True]),
])
def test_custom_dsn_is_bounded_by_the_call(scan, m, flagged):
    rows, = scan(m)
    assert [r.custom_dsn for r in rows] == flagged


def test_arguments_nested_far_beyond_the_pattern(scan):
    inner = "(" * 40 + '"x"' + ")" * 40
    rows, open_rows = scan(
        f'Snowflake.Databases({inner}, [Implementation = "1.0"]) & Impala.Database("y", [Implementation="2.0"])',
        f'Snowflake.Databases({inner} & Impala.Database("y", [Implementation="2.0"])',
    )
    assert [r.implementation for r in rows] == ["1.0", "2.0"]
    assert [r.implementation for r in open_rows] == ["2.0", "2.0"]


def test_excerpt_window_is_whole_and_redacted(scan):
    lead, rest = "x" * 100, "y" * 400
    (row,), = scan(f'{lead} Odbc.DataSource("uid=me;pwd=abc", \n{rest})')
    assert row.excerpt.startswith("x" * 39 + " Odbc.DataSource(\"uid=me;pwd=***REDACTED***")
    assert "\n" not in row.excerpt and "abc" not in row.excerpt
    assert row.endpoint_hint == "uid=me;pwd=***REDACTED***"


@pytest.mark.parametrize("value, expected", [
    ("driver={SQL};server=p;PWD=h;db=x", "driver={SQL};server=p;PWD=***REDACTED***;db=x"),
    ('Token = "a b c" rest', "Token=***REDACTED*** rest"),
    ("uid=me;user=you", "uid=me;user=you"),
    ('shared ApiKeyProd = "sk-live" meta [x]', 'shared ApiKeyProd = "***REDACTED***" meta [x]'),
    ("see eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSM now", "see ***REDACTED*** now"),
    ("nothing", "nothing"),
])
def test_redaction_and_its_repetition(spark, value, expected):
    row = spark.createDataFrame([(value,)], "t string").select(text.redact_secrets(F.col("t")).alias("a")).select(
        "a", text.redact_secrets(F.col("a")).alias("b")).first()
    assert row.a == expected and row.b == expected


def test_truncation(spark):
    rows = spark.createDataFrame([("a" * 10,), ("b\n" * 6,)], "t string").select(text.truncate_marked(F.col("t"), 10))
    assert [r[0] for r in rows.collect()] == ["a" * 10, "b\n" * 5 + " ...(truncated)"]


def _reference_mask(m: str) -> str:
    """Character by character, for comparison with the pattern on random texts."""
    out, state, i = [], "code", 0
    while i < len(m):
        pair = m[i:i + 2]
        if state == "code" and pair == "//":
            state = "line"
        elif state == "code" and pair == "/*":
            state = "block"
            out.append("  ")
            i += 2
            continue
        elif state == "code" and m[i] == '"':
            state = "text"
        elif state == "text" and pair == '""':
            out.append(pair)
            i += 2
            continue
        elif state == "text" and m[i] == '"':
            state = "code"
        elif state == "line" and m[i] == "\n":
            state = "code"
        elif state == "block" and pair == "*/":
            state = "code"
            out.append("  ")
            i += 2
            continue
        out.append(m[i] if state in ("code", "text") else " ")
        i += 1
    return "".join(out)


def test_masking_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('ab"/*\n (.)') for _ in range(rng.randint(0, 60))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.mask_comments(F.col("t")).alias("m"), text.mask_strings(F.col("t")).alias("s"))
    for row in df.collect():
        assert row.m == _reference_mask(row.t), row.t
        assert len(row.s) == len(row.t)


def test_windows_against_brute_force(spark):
    rng = random.Random(9)
    pieces = ["F.x(", ")", "(", '"s)("', ",", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "expression string")
    got = {}
    for r in calls.call_sites(df.withColumn("t", F.col("expression")), excerpts=False).collect():
        got.setdefault(r.t, set()).add((r.call_pos, r.window))
    for t in texts:
        want, n = set(), 0
        blank = t.replace('"s)("', '"s__"')
        for i in range(len(t)):
            if blank.startswith("F.x(", i):
                depth, end = 0, len(t)
                for j in range(i + 3, len(t)):
                    depth += (blank[j] == "(") - (blank[j] == ")")
                    if depth == 0:
                        end = j + 1
                        break
                want.add((n, t[i + 3:end]))
                n += 1
        assert got.get(t, set()) == want, t


def _reference_facts(t):
    """Per call of a text without comments: window, first literal, pin and raw-DSN flag, by plain walks."""
    quoted, shown = False, []
    for ch in t:
        quoted ^= ch == '"'
        shown.append("_" if quoted and ch in "()" else ch)
    shown = "".join(shown)
    for head in re.finditer(r"\b[A-Za-z]+(?:\.[A-Za-z]+)+\s*\(", shown):
        depth, end = 0, len(t)
        for j in range(head.end() - 1, len(t)):
            depth += (shown[j] == "(") - (shown[j] == ")")
            if depth == 0:
                end = j + 1
                break
        window = t[head.end() - 1:end]
        literal = re.search('"([^"]+)"', window)
        pin = re.search(r"""(?i)Implementation\s*=\s*['"]([^'"]+)['"]""", window)
        dsn = any(re.search("(?i)" + p, window) for p in fv.CUSTOM_DSN_PATTERNS)
        yield window, literal and literal[1], pin and pin[1], dsn


def test_deep_and_open_calls_against_brute_force(spark):
    rng = random.Random(11)
    pieces = ["Sql.Database(", "A.b (", "(", ")", '"x"', '""', '"a)b("', '"', ", ", "Implementation = '", '[Implementation="2.0"]',
              "Implementation='A.b(Implementation='2')", "Driver={x}", 'DSN="', "Odbc.Query(", " é ", "'"]
    nested = ["A.b(" * d + rng.choice(pieces[4:]) + ")" * rng.randint(0, d) for d in (11, 12, 13, 14, 20, 40)]
    texts = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(400)} | set(nested))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, expression string")
    windows, details = {}, {}
    for r in calls.call_sites(df, excerpts=False).collect():
        windows.setdefault(r.id, {})[r.call_pos] = r.window
    for r in calls.scan_expressions(df, excerpts=False).collect():
        details.setdefault(r.id, {})[r.call_pos] = (r.endpoint_hint, r.implementation, r.custom_dsn, r.m_function)
    for i, t in enumerate(texts):
        for n, (window, literal, pin, dsn) in enumerate(_reference_facts(t)):
            if n not in windows.get(i, {}):
                continue  # a built-in prefix
            assert windows[i][n] == window, t
            got = details[i][n]
            assert got[:3] == (text_of(literal), pin, dsn or got[3].split(".")[0].lower() in fv.CUSTOM_DSN_PREFIXES), (t, n)


def text_of(literal):
    return literal if literal is None or len(literal) <= fv.ENDPOINT_CAP else literal[:fv.ENDPOINT_CAP] + fv.TRUNCATION_MARK


@pytest.mark.parametrize("shape", ["open", "nested", "mixed"])
def test_time_follows_the_length_of_the_text(spark, shape):
    def text_with(n):
        call = 'Sql.Database("s", [Implementation="1.0"], '
        return call * n + {"open": "", "nested": ")" * n, "mixed": ")" * (n // 2)}[shape]

    def seconds(n):
        df = spark.createDataFrame([(text_with(n),)], "expression string")
        start = time.perf_counter()
        rows = calls.scan_expressions(df).agg(F.count("*"), F.count("implementation"), F.count("endpoint_hint")).collect()[0]
        assert list(rows) == [n, n, n]
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 6 * max(seconds(4_000), 0.5)


def test_totals_and_matches(spark):
    rng = random.Random(4)
    rows = [([rng.randint(-9, 9) for _ in range(n)], "".join(rng.choice("ab(é)𝄞") for _ in range(n))) for n in (0, 1, 255, 256, 257, 700, 70_000)]
    df = spark.createDataFrame(rows, "v array<bigint>, t string").select(
        "v", "t", F.expr(arrays.running_totals("v")).alias("sums"), F.expr(arrays.matches("t", "[ab]+")).alias("m"))
    for r in df.collect():
        assert r.sums == list(itertools.accumulate(r.v))
        assert [(m.start, m.end, m.value) for m in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[ab]+", r.t)]
