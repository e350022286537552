"""The assignment lexer: planted literals of many syntaxes, and generated files whose secrets are known."""

import random
import time

import pytest

pytest.importorskip("spanwood.llm")
from spanwood.llm import secrets  # noqa: E402

V = "zX81pQ77mmLw02"
FOUND = {
    "chain": (f'A = B = "{V}"\npassword = A', [V]),
    "chained target": (f'A = db_pwd = "{V}"', [V]),
    "backticks": (f"db_pwd = `{V}`", [V]),
    "block scalar": (f"password: |\n  {V}\nother: 1", [V]),
    "scalar below its key": (f"pwd:\n  {V}\n", [V]),
    "tag": (f"<password>{V}</password>", [V]),
    "attributes": (f'<add key="pwd" value="{V}"/>', [V]),
    "call": (f'cfg.set("pwd", "{V}")', [V]),
    "setter": (f'setPwd("{V}")', [V]),
    "subscript": (f'config["pwd"] = "{V}"', [V]),
    "hash": (f"{{'db_pwd' => '{V}'}}", [V]),
    "macro": (f'#define DB_PWD "{V}"', [V]),
    "constant after its use": (f'my_pwd = A\nA = "{V}"', [V]),
    "constant of an outer scope": (f'K = "{V}"\ndef g():\n    db_pwd = K\n', [V]),
    "strings side by side": ('pwd = "zX81pQ77" "mmLw0299"', ["zX81pQ77", "mmLw0299"]),
    "lines in parentheses": ('db_pwd = ("zX81"\n  "pQ77mm")', ["zX81", "pQ77mm"]),
    "dots": ('$db_pwd = "zX81" . "pQ77mm";', ["zX81", "pQ77mm"]),
    "sum without gaps": ('db_pwd = K+"pQ77mm"\nK="zX81"', ["zX81", "pQ77mm"]),
    "phrase": ('password = "correct horse battery staple"', ["correct horse battery staple"]),
    "comment": (f'# db_pwd = "{V}"\n', [V]),
    "string in a string": (f'run("mysql --db-pwd={V} -h x")', [V]),
    "option": (f"curl --pwd {V}", [V]),
    "here-document": (f"db_pwd = <<~EOS\n  {V}\nEOS\n", [V]),
    "three quotes": (f"db_pwd = '''{V}'''", [V]),
    "quote in a comment": (f'K = "{V}" # it\'s\ndb_pwd = K', [V]),
    "long literal": ('db_pwd = "' + "aB3xY7qWzP" * 60 + '"', ["aB3xY7qWzP" * 60]),
}
NOT = {
    "message": 'password: "please enter your password here"',
    "other function's constant": f'def f():\n    K = "{V}"\n\ndef g():\n    K = "plainvalue"\n    db_pwd = K\n',
    "other block's constant": f'function f() {{ const K = "{V}"; }}\nfunction g() {{ const K = "x"; my_pwd = K; }}',
    "condition": f"if pwd:\n  {V}\n",
    "harmless name": f'colour = "{V}"\npublic_key = "{V}"',
    "constant in a comment": f'# K = "{V}"\ndb_pwd = K\n',
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_planted(name):
    text, want = FOUND[name]
    assert sorted(text[a:b] for a, b in secrets.pairs(text)) == sorted(want)
    assert not any(v in secrets.masked(text) for v in want)


@pytest.mark.parametrize("name", sorted(NOT))
def test_left_alone(name):
    assert secrets.pairs(NOT[name]) == []


def test_generated_files_against_their_recipe():
    """Files of assignments to names that are sensitive or not, some through constants: the recipe knows the secrets."""
    rng = random.Random(4)
    forms = ['{n} = "{v}"', "{n}: '{v}'", '"{n}": "{v}",', "{n} := `{v}`", '{n} => "{v}"', '<{n}>{v}</{n}>', 'conf.set("{n}", "{v}")', 'let {n}: str = "{v}";']
    for _ in range(200):
        lines, want, constants = [], set(), {}
        for k in range(rng.randint(1, 30)):
            value = "".join(rng.choice("abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQR") for _ in range(10)) + f"{rng.randint(10, 99)}x{k}"
            name = rng.choice(["db_pwd", "passphrase", "shade", "width", "clientPwd", "label_pwd"])
            if rng.random() < 0.3:
                constants[f"C{k}"] = value
                lines.append(f'C{k} = "{value}"')
                if rng.random() < 0.5:
                    lines.append(f"{name} = C{k}")
                    want |= {value} if name in ("db_pwd", "passphrase", "clientPwd") else set()
            else:
                lines.append(rng.choice(forms).format(n=name, v=value))
                want |= {value} if name in ("db_pwd", "passphrase", "clientPwd") else set()
        text = "\n".join(lines)
        assert {text[a:b] for a, b in secrets.pairs(text)} == want, text


def test_base_spans_cover_pairs_in_one_sweep():
    text = "".join(f'token = "abc{k}defgh123"\n' for k in range(3000)) + f'db_pwd = "{V}"'
    base, all_ = secrets.spans(text)
    assert len(base) == 3000 and [k for _, k, _ in all_].count("pair") == 1


@pytest.mark.parametrize("unit", ["# ", "// ", "<!-- ", "/* ", "-- ", "#", "<password>a" + " " * 500, "\"'`", "<<a ", "<<a\n", "{a=b", "{q=z;", "<tag " + "a" * 1000, '"""', "a: |\n ", "password: ", "token=token=", '\\"', "password=\"", "  - password:\n", '""" # '])
def test_long_odd_texts(unit):
    """A megabyte of signs that open something takes seconds, and hides no secret before it."""
    text = 'password = "hunter2hunter2"\n' + unit * (1_000_000 // len(unit))
    began = time.time()
    base, found = secrets.spans(text)
    assert time.time() - began < 40 and base[0][:2] == (0, "assign") and found[0] == base[0]


def test_comments_in_comments():
    text = "# // see # password_key := zX81pQ77mmLw02kk9\n/* // <!-- api_secret: 'qW9zX81pQ77mmLw02' */"
    assert [text[a:b] for a, b in secrets.pairs(text)] == ["zX81pQ77mmLw02kk9", "qW9zX81pQ77mmLw02"]
    text = "<password>\n   zX81pQ77mmLw02kk9   \n</password>"
    assert [text[a:b] for a, b in secrets.pairs(text)] == ["zX81pQ77mmLw02kk9"]
