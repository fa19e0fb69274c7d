import hashlib
import random
import re

import pytest

from rivermark.llm import licenses, secrets
from tests.llm.conftest import ODD

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_by_hand(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return (*[sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")], hashlib.sha256(joined.encode()).hexdigest())


def test_secrets(spark, rows_of):
    r = random.Random(4)
    bits = ['password = "', "TOKEN: ", "Api_Key='", "apikey=", "secret  :", "passwd", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "Zz9+/_.=-", "ABCDEFGH01234567", " ", "\n", "é😀", "=", "'"]
    pairs = ODD + [(100 + k, "".join(r.choice(bits) for _ in range(r.randint(1, 25)))) for k in range(400)]
    pairs += [(900, "token: password: abcdefghijklmnop"), (901, "ghp_" + "a1B2" * 9), (902, "-----BEGIN RSA PRIVATE KEY-----")]
    got = secrets.report(secrets.scan(rows_of(pairs))).collect()
    assert sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got) == sorted(str((i, *base_by_hand(t))) for i, t in pairs)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[901] == "github:0:40" and spans[902] == "pem:0:31"
    assert secrets.scan(rows_of([])).count() == 0


@pytest.mark.parametrize("pattern", [r.pattern for r in secrets.BASE + secrets.MORE] + ["abc|xyzw", "(abc|x)def", "ab?cde+f", "[a-c]xyz", "a{3}bc", "(ab){2,}c", "x.*yzw", "(foo|ba+r)baz"])
def test_queries_never_miss(pattern):
    """Whatever a pattern matches satisfies its query."""
    r, query, hits = random.Random(1), secrets.trigram_query(pattern), 0
    words = ["password=", "token: ", "api_key='", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "abcdefghijklmnopqrst", "ghp_", "xoxb-", "AIza", "sk_live_",
             "eyJ", "eyJabcdefghijkl.", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "abc", "xyzw", "x", "def", "ab", "cde", "f", "aaabc", "abab", "c", "yzw", "foo", "baar", "baz", "bxyz"]
    for _ in range(4000):
        text = "".join(r.choice(words) for _ in range(r.randint(1, 6)))
        if re.search(pattern, text):
            hits += 1
            low = text.lower()
            assert all(any(all(g in low for g in grams) for grams in part) for part in query)
    assert hits


def test_rules_without_trigrams_scan_fully():
    assert secrets.trigram_query("[0-9a-f]{16,}") == [] and secrets.trigram_query("(abc|x)") == []


def dice_by_hand(text, templates, least=licenses.LEAST):
    """Every license of a text with its best window, by sets."""
    words, found = licenses._words_py(text or ""), set()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, template in templates.items():
        own, w = set(licenses._bigrams_py(template)), len(licenses._words_py(template))
        scored = [(2 * len(own & set(x)) / (len(set(x)) + len(own)), -i) for i, g in enumerate(grams) if g in own for x in [grams[i : i + w - 1]]]
        if scored and max(scored)[0] >= least:
            found.add((name, -max(scored)[1], round(max(scored)[0], 9)))
    return found


def found(rows):
    return sorted((str(r.doc_id), r.license, r.position, round(r.dice, 9)) for r in rows.collect())


def test_licenses(spark, rows_of):
    mit = licenses.TEMPLATES["MIT-text"]
    wrapped = re.sub(r"(.{40,60}) ", r"\1\n", mit)
    pairs = ODD + [
        (50, "Prose here.\nLicensed under  the APACHE license, version 2.0\nMore."), (51, f"Head line\n\n{wrapped}\nint main() {{}}"), (52, "Licensed under the moon."),
        (53, mit), (54, "This project is released under the MIT License."), (55, "Some prose here about it. Released under the MIT License. And more of it."),
        (56, f"/* {licenses.TEMPLATES['BSD-2-Clause-text']} */ int x; /* {wrapped} */"),
    ]
    got = found(licenses.matches(rows_of(pairs)))
    assert got == sorted((str(i), *m) for i, t in pairs for m in dice_by_hand(t, licenses.TEMPLATES))
    names = {(i, name) for i, name, _, _ in got}
    assert {("50", "Apache-2.0"), ("51", "MIT-text"), ("53", "MIT-text"), ("54", "MIT"), ("55", "MIT"), ("56", "BSD-2-Clause-text"), ("56", "MIT-text")} <= names
    assert not {i for i, _ in names} & {"52", "1", "2", "9"} and (("53", "MIT-text", 0, 1.0)) in got
    assert licenses.matches(rows_of(pairs), {}).count() == 0 and licenses.matches(rows_of([])).count() == 0


def test_pruning_loses_nothing(spark, rows_of):
    """Against Dice of every window with every template."""
    r = random.Random(6)
    texts = []
    for k in range(250):
        words = r.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(r.randint(0, 12)):
            words.insert(r.randrange(len(words) + 1), r.choice(("the", "license", "software", "x", "under")))
        for _ in range(r.randint(0, 6)):
            if len(words) > 3:
                words.pop(r.randrange(len(words)))
        around = [r.choice(("a", "prose", "word", "the", "license")) for _ in range(r.choice([0, 0, 30]))]
        texts.append((k, " ".join([*around, *words, *around])))
    texts.append((999, " ".join(licenses.TEMPLATES.values())))
    want = sorted((str(i), *m) for i, t in texts for m in dice_by_hand(t, licenses.TEMPLATES))
    assert found(licenses.matches(rows_of(texts))) == want and len(want) > 100


def test_needles_are_in_every_match():
    grams = {name: licenses._bigrams_py(text) for name, text in licenses.TEMPLATES.items()}
    words, pairs = licenses.needles(grams, licenses.LEAST)
    for own in grams.values():
        without = [g for g in own if g not in pairs and not any(w in part for part in g.split(" ") for w in words)]
        assert len(without) < licenses._needed(own, licenses.LEAST)
