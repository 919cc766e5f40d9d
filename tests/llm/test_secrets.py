import hashlib
import random
import re
import time

import pytest

from wayfloor.llm.lexing import Reader, Values
from wayfloor.llm.secrets import find_secrets, redact_secrets, secrets_digest, spans_of


def brute(text):
    found, n = brute_spans(text)
    return (*n, hashlib.sha256(",".join(found).encode()).hexdigest())


def brute_spans(text):
    text = text or ""
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)]
    found, n = [], []
    for k, (name, pattern, least) in enumerate(kinds):
        flags = re.I | re.A if name == "assign" else 0
        hits = [m for m in re.finditer(pattern, text, flags) if len(m[2] if name == "assign" else m[0]) >= least]
        n.append(len(hits))
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in hits]
    return [x for *_, x in sorted(found)], n


def texts():
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "  = ", "hunter2hunter2", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "é", "\n", "x", "ſ", "secret = abc", "-", "passwd:"]
    return [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in secrets_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == brute(t), repr(t)
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("lexed")] == brute_spans(t)[0]


def lexed(text):
    return [text[a:b] for a, b, k in spans_of(text) if k == 3]


def test_lexer_pairs_names_and_literals():
    assert lexed('db_passphrase = "Zx9-kkQw81pT"') == ["Zx9-kkQw81pT"]
    assert lexed("client:\n  private_key: Ab3dEf6hIj9l\n") == ["Ab3dEf6hIj9l"]
    assert lexed('{"credentials": "qWe4rTy7uIo0"}') == ["qWe4rTy7uIo0"]
    assert lexed("password_length = 12345678901") == []
    assert lexed('password = "changeme"') == [] and lexed("note: see chapter 12, and so on") == []


def test_constants_propagate():
    assert lexed('K = "Zx9-kkQw81pT"\nother = 1\nsigning_secret = K\n') == ["Zx9-kkQw81pT"]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a password=hunter2hunter2 b"), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact_secrets(docs).collect()} == {1: "a [SECRET] b", 2: None, 3: "clean"}


def test_edges(edge_docs, empty_docs):
    assert secrets_digest(edge_docs).count() == edge_docs.count()
    assert secrets_digest(empty_docs).count() == 0
    assert find_secrets(edge_docs).where("size(spans) > 0").count() == 1  # the run of a is hexadecimal


def test_typed_chained_and_nested_assignments():
    for t in ('password: str = "{}"', 'let api_key: String = "{}";', "const authToken: string | undefined = '{}'", 'secret: Optional[str] = "{}"'):
        assert "Zx9-kkQw81pT" in lexed(t.format("Zx9-kkQw81pT")), t
    assert lexed('a = db_pwd = "Zx9-kkQw81pT"') == ["Zx9-kkQw81pT"]
    assert lexed('db_pwd = a = "Zx9-kkQw81pT"') == ["Zx9-kkQw81pT"]
    assert lexed("env:DB_PWD=Zx9-kkQw81pT") == ["Zx9-kkQw81pT"]
    assert lexed('K: str = "Zx9-kkQw81pT"\nsigning_secret = K\n') == ["Zx9-kkQw81pT"]
    assert lexed('def f(password: str, url="Zx9-kkQw81pT")') == []


V = "Zx9-kkQw81pT"


def test_syntaxes():
    """Every target of a literal that the lexer knows."""
    for t in [
        'x = 1\ndb_pwd = """{}"""', "config[\"db_pwd\"] = '{}'", "var dbPwd string = \"{}\"", "const dbPwd: string = `{}`", '#define DB_PWD "{}"', "db_pwd = b'{}'", 'db_pwd = f"{}"',
        "db_pwd := '{}'", "'db_pwd' => '{}',", "define('DB_PWD', '{}');", "ENV DB_PWD {}", "export DB_PWD={}", "- db-pwd: {}\n  user: me", '<db_pwd>{}</db_pwd>', '<server db-pwd="{}" port="1"/>',
        '<add key="DbPwd" value="{}"/>', "db_pwd: |\n  {}\nnext: 1", "char db_pwd[] = \"{}\";", "Dim dbPwd As String = \"{}\"", "self.db_pwd = ('{}')", 'obj->db_pwd = "{}";', "# db_pwd = '{}'",
        'connect(host="h", db_pwd="{}")', 'let dbPwd: Option<&str> = "{}";', 'db_pwd = SecretStr("{}")', '{{"db": {{"db_pwd": "{}"}}}}', "db_pwd ?= '{}'", "url?x=1&db_pwd={}&y=2",
    ]:
        assert lexed(t.format(V)) == [V], t


def test_sums_scopes_and_order():
    assert lexed('db_pwd = "Zx9-kk" + "Qw81pT"') == ["Zx9-kk", "Qw81pT"]
    assert lexed('db_pwd = ("Zx9-kk"\n   "Qw81pT")') == ["Zx9-kk", "Qw81pT"]
    assert lexed('def f():\n    db_pwd = K\n\nK = "Zx9-kkQw81pT"\n') == [V]
    assert lexed('def f():\n    K = "Zx9-kkQw81pT"\n\ndb_pwd = K\n') == []
    assert lexed('K = "aaaaaaaaaaaa"\nK = "Zx9-kkQw81pT"\ndb_pwd = K\nK = "bbbb-bbbb-bbbb"\n') == [V]
    assert lexed('A = "Zx9-kkQw81pT"\nB = A\ndb_pwd = B\n') == [V]
    assert lexed("A = B\nB = A\ndb_pwd = A\n") == []


def test_what_is_no_secret():
    for t in ["The db_pwd: {} is shown", 'db_pwd = os.getenv("{}")', 'print("db_pwd {}")', "db_pwd_hint = '{}'", 'see https://db_pwd/{}', "if db_pwd == '{}':", "db_pwd = '${{{}}}'", "my pwd, '{}'"]:
        assert lexed(t.format(V)) == [], t


def test_lexed_spans_match_brute_force():
    """Random files of lines whose secrets are known by construction."""
    rng = random.Random(5)
    secret = lambda: "".join(rng.choice("abcdefghXYZ23456789_-") for _ in range(14)) + "aX7-"
    harmless = ["# it's a comment", "x = compute(1, 'a b')", "for k in range(3):", "say 'hello world' to you", "color: blue", "}", "{", '"open quote', "(a, b)", "port = 8080", "<p>text</p>"]
    for _ in range(300):
        lines, want, constants, at = [], [], [], 0
        for _ in range(rng.randint(1, 14)):
            v, which = secret(), rng.randrange(9)
            name = rng.choice(["db_pwd", "authToken", "SIGNING_SECRET", "apiKey", "client.passphrase"])
            line, found = rng.choice(harmless), None
            if which == 0:
                line, found = f'{name} = "{v}"', v
            elif which == 1:
                line, found = f"{name}: {v}", v
            elif which == 2:
                line, found = f"conf['{name.replace('.', '_')}'] = '{v}'", v
            elif which == 3:
                line = f"K{len(constants)} = '{v}'"
                constants.append([v, at, False])
            elif which == 4 and constants:
                k = rng.randrange(len(constants))
                line, constants[k][2] = f"{name} = K{k}", True
            elif which == 5:
                line, found = f'<{name.split(".")[0]}_pwd>{v}</{name.split(".")[0]}_pwd>', v
            elif which == 6:
                line = f'other_name = "{v}"'
            if found:
                want.append(at + line.index(v))
            if which == 3:
                constants[-1][1] = at + line.index(v)
            lines.append(line)
            at += len(line) + 1
        text = "\n".join(lines)
        want += [a for _, a, used in constants if used]
        got = sorted(a for a, b, k in spans_of(text) if k == 3)
        assert got == sorted(want), text
        assert all(b - a == 18 for a, b, k in spans_of(text) if k == 3), text


MEGABYTE = {
    "sums of sums": "\n".join(f"K{i} = " + " + ".join([f"K{i + 1}"] * 6) for i in range(20_000)) + f'\nK20000 = "{V}"\ndb_pwd = K0\n',
    "one tag": "db_pwd <" + ' name="a"' * 110_000,
    "closed tags": "db_pwd " + '<a name="b" value=' * 55_000,
    "names of dots": "db_pwd <" + "a.b-" * 250_000,
    "redefined in closed scopes": "{ K = 'abcdefgh12' }\n" * 48_000 + "db_pwd = K\n" * 100,
    "used in closed scopes": "{ K = 'abcdefgh12' } db_pwd = K\n" * 30_000,
    "nested scopes": "{ K = 'abcdefgh12'; db_pwd = K;\n" * 30_000,
    "defined after": "db_pwd = K\n" * 40_000 + "{ K = 'abcdefgh12' }\n" * 20_000,
    "unclosed quotes": "db_pwd = \"\n" * 100_000,
    "escaped quotes": "db_pwd = " + '\\"' * 500_000,
    "unclosed triples": "db_pwd = '''" + '\\"""' * 250_000,
    "marks": "db_pwd " + "-" * 1_000_000,
    "brackets": "db_pwd" + '["x"]' * 200_000 + " = 1",
    "parentheses": "db_pwd = " + "(" * 1_000_000,
    "chain": "a = " * 250_000 + f'db_pwd = "{V}"',
    "long sum": "db_pwd = " + '"ab" + ' * 140_000 + '"cd"',
    "ring": "\n".join(f"db_pwd{i} = 'x' + db_pwd{(i * 7 + 1) % 20_000}" for i in range(20_000)),
    "lines": "db_pwd: |\n" + "  x\n" * 250_000,
    "elements": "<db_pwd>" * 120_000,
    "spaces": "db_pwd" + " " * 1_000_000 + "= x",
    "bare": "db_pwd=" + "&a" * 500_000,
    "backticks": "db_pwd = `" + "a" * 1_000_000,
}


@pytest.mark.parametrize("kind", sorted(MEGABYTE))
def test_a_megabyte_takes_seconds(kind):
    began = time.time()
    spans_of(MEGABYTE[kind])
    assert time.time() - began < 12  # some two seconds on an idle machine


def test_short_texts_of_many_sums():
    text = "\n".join(f"K{i} = " + " + ".join([f"K{i + 1}"] * 6) for i in range(8)) + f'\nK8 = "{V}"\ndb_pwd = K0\n'
    assert lexed(text) == [V]


def plain_meant(reader, name, place, part):
    """The rule, over all pairs in order."""
    found = [p for p in reader.pairs if name in p.names and p.parts[0] != part and reader.scopes[p.scope][0] <= place < reader.scopes[p.scope][1]]
    before = [p for p in found if p.at < place]
    return before[-1] if before else found[0] if found else None


def test_references_match_brute_force():
    """Random scopes and constants: every reference leads where the plain rule does, and literals are those that can be reached."""
    rng = random.Random(8)
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 25)):
            name, other = rng.choice("ABC"), rng.choice("ABCD")
            lines.append(rng.choice(["{", "}", "def f():", "    ", "{ ", f"{name} = 'value{rng.randint(0, 9)}'", f"{name} = 'x' + {other}", f"{name} = ('a' + {other} + {name})", f"  {name} = {other}", f"db_pwd = {name}"]))
        reader = Reader("\n".join(lines))
        reader.read()
        values = Values(reader)
        for i, p in enumerate(reader.pairs):
            leads, spans = [], []
            for part in p.parts:
                if isinstance(part[0], int):
                    spans.append(part)
                elif (q := plain_meant(reader, part[0], part[1], part)) is not None:
                    leads.append(next(k for k, r in enumerate(reader.pairs) if r is q))
                elif part[2]:
                    spans.append(part[2])
            assert values.leads[i] == leads and values.literals[i] == spans, lines
        for found in values.classes(list(range(len(reader.pairs)))):
            for i in found:
                assert set(found) <= closure(values, i)


def closure(values, i):
    seen, ring = {i}, [i]
    while ring:
        ring = [j for k in ring for j in values.leads[k] if j not in seen and not seen.add(j)]
    return seen
