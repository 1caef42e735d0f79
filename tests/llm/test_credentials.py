import hashlib
import random
import re

from wattlink.llm import credentials as C


def by_hand(text):
    text = text or ""
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(pattern.replace("(password", "((?ai:password").replace("key)", "key))"), text)
             if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort()
    return [sum(s[1] == k for s in spans) for k in range(3)], ",".join(f"{C.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fixture():
    rng = random.Random(7)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [None, "", "token: token: abcdef", 'É PassWord="abc" secret=abcdefgh', "apikey:'a.b-c=d+e/f' api_key = short", "AKIA" + "A" * 15,
             "AKIAAKIA" + "B7" * 8, "x" + "a" * 24 + "g" + "0" * 23, "tokens: 123456789", "ſecret=abcdefg toKen=abcdefg",
             "mail some.one.42@mail7.example.com and 4556123412341234 here"]
    texts += [f"word number {i} token = {hexes(40)} and more" for i in range(60)]
    texts += [f"mail the.person.{i}@mail.example.com visited-page-number-{i}-of-the-day" for i in range(60)]
    texts.append("a key " + hexes(12) + hexes(11).upper() + " alone")
    texts.append("a split key " + hexes(22) + " alone")
    return texts


def test_base_spans_match_plain_patterns_and_stay(spark):
    texts = fixture()
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in C.scan(docs).collect()}
    for i, t in enumerate(texts):
        counts, joined = by_hand(t)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts, t
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("learned")] == [s for s in joined.split(",") if s]
    learned = {i for i, r in got.items() if r["n_learned"]}
    assert len(texts) - 1 in learned and not learned & set(range(71, 131)) and 10 not in learned


def test_automaton_tells_formats_apart():
    rng = random.Random(1)
    a = C.Automaton(["ab" + "".join(rng.choice("0123456789") for _ in range(8)) for _ in range(300)], 0.05)
    assert len(a.next) < 40 and a.score("ab12345678") > a.score("12345678ab") + 5
    assert C.Automaton([], 0.05).score("abc") < 0


def test_redaction_keeps_everything_else(spark):
    docs = spark.createDataFrame(
        [(1, "my token = abcdefgh1 end", 24, "x"), (2, None, 0, "y"), (3, "clean", 99, None)], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in C.redacted(docs).collect()}
    assert got[1]["text"] == "my token = [secret] end" and got[1]["n_chars"] == 23 and got[1]["spans"] == "x"
    assert got[2]["text"] is None and (got[3]["text"], got[3]["n_chars"]) == ("clean", 99)
    assert C.redacted(docs.limit(0)).count() == 0 and C.scan(docs.limit(0)).count() == 0
    assert C.redact("a token=" + "b" * 24 + " c", C.base_spans("a token=" + "b" * 24 + " c")) == "a token=[secret] c"


def test_rare_kinds_are_labelled_in_every_row(spark):
    rng = random.Random(9)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    strings = {secret() for _ in range(24)}
    texts = [f"token = {s}" for s in strings] + ["plain text"] * 60_000 + [f"ordinary-page-number-{i}-of-the-day" for i in range(40)]
    texts += ["key " + secret()[:12] + secret()[:11].upper() + " alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scanner = C.fitted(docs)
    assert len(scanner.formats) == 2 and scanner.ordinary is not None  # assigned values, and hex runs
    few = C.fitted(docs, C.Fit(strings=20))
    want = sorted(strings, key=lambda s: C.xxhash.xxh64_intdigest(s.encode(), 42))[:20]
    assert few.formats[0].visits == C.Automaton(want, 0.05).visits


def brute_candidates(text):
    """Maximal stretches of credential characters that no base span covers, character by character."""
    free = [bool(re.match("[A-Za-z0-9+/_.=-]", c)) for c in text]
    cut = [False] * (len(text) + 1)
    whole = re.finditer("[A-Za-z0-9+/_.=-]+", text)
    long = {i for m in whole if len(m[0]) >= 6 for i in range(*m.span())}
    for s, _, e, _ in C.base_spans(text):
        for i in range(s, e):
            free[i], cut[i] = False, True
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and free[j] and j in long:
            j += 1
        if j > i:
            a, b = i, j
            while a < b and i and cut[i - 1] and text[a] in "+/_.=-":
                a += 1
            while b > a and cut[j] and text[b - 1] in "+/_.=-":
                b -= 1
            if b - a >= 6 and re.search("[A-Za-z]", text[a:b]):
                out.append((a, b))
        i = max(j, i + 1)
    return out


def test_candidates_match_brute_force():
    rng = random.Random(12)
    bits = ["AKIA" + "A1" * 8, "token=", "password: ", "abcdef12", "/", "=", ".", " ", "x" * 9, "0123456789", "f" * 24, "Zq9", "--", "\n", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    found = [C.candidates(t, C.base_spans(t)) for t in texts]
    assert found == [brute_candidates(t) for t in texts] and sum(map(len, found)) > 500


def test_rest_of_a_touched_run_is_scored_and_redacted(spark):
    rng = random.Random(3)
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [f"secret = {mixed(40)}" for _ in range(80)] + [f"ordinary-page-number-{i}-of-the-day" for i in range(80)]
    key, rest = "AKIA" + "B7" * 8, mixed(40)
    letters = "".join(c for c in mixed(90) if c.isalpha())[:40]
    texts += [f"uses {key}/{rest} here", f"alone {letters} here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in C.redacted(docs).collect()}
    assert got[160] == "uses [secret]/[secret] here" and got[161] == "alone [secret] here"
    assert all(got[i] == t for i, t in enumerate(texts) if 80 <= i < 160)


def test_one_state_gives_plain_letter_shares():
    """With a bound that nothing exceeds all states merge into one, whose scores are letter shares."""
    import math
    strings = ["ab", "abb", "b", "aab"]
    a = C.Automaton(strings, 2 * math.exp(-2 * 3 ** 2))
    n, text = len("".join(strings)), "".join(strings)
    assert len(a.next) == 1 and a.visits == [n + len(strings)] and a.ends == [len(strings)]
    share = {c: (text.count(c) + (text.count(c) + 1) / (n + 66)) / (n + len(strings) + 1) for c in "ab"}
    want = math.log(share["a"]) + math.log(share["b"]) + math.log((len(strings) + 0.1) / (n + len(strings) + 1))
    assert abs(a.score("ab") - want) < 1e-12
    # and with one that everything exceeds, the prefix tree stays as it is
    tree = C.Automaton(["abc"] * 50 + ["abd"] * 50 + ["xyz"] * 50, 1.9)
    assert len(tree.next) > 3 and tree.score("abc") > tree.score("xbc")


def test_short_credentials_are_scored_and_words_stay(spark):
    rng = random.Random(5)
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    words = ["".join(rng.choice(["ba", "ne", "ti", "lo", "ru", "sha", "men", "ter"]) for _ in range(rng.randrange(3, 6))) for _ in range(400)]
    texts = [f"token={mixed(8)} " + " ".join(rng.sample(words, 12)) for _ in range(300)]
    texts += [f"code {mixed(8)} here", " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in C.scan(docs).collect()}
    assert got[300]["spans"] == "learned:5:13" and sum(r["n_learned"] for r in got.values()) == 1


def test_verdicts_do_not_depend_on_what_is_remembered(monkeypatch):
    rng = random.Random(6)
    a = C.Automaton(["k" + "".join(rng.choice("0123456789") for _ in range(9)) for _ in range(200)], 0.05)
    b = C.Automaton(["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(200)], 0.05)
    tokens = [rng.choice(["k", "b"]) + "".join(rng.choice("0123abcd") for _ in range(rng.randrange(6, 90))) for _ in range(300)] * 2
    monkeypatch.setattr(C, "KNOWN", 7)
    one = C.Scanner([a], b, C.Fit())
    found = [one.secret(t) for t in tokens]
    assert found == [C.Scanner([a], b, C.Fit()).secret(t) for t in tokens] and 0 < sum(found) < len(found)
