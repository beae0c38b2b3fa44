from __future__ import annotations

import random
import re

from furrow.llm import pii

from .conftest import ODD, frame

# The published rules, in natural form.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES.items())
                  for m in re.finditer(rule, text or "") if valid(kind, m.group()))


def base(rows):
    return sorted((r["doc_id"], [tuple(s) for s in r["base"]]) for r in rows)


SAMPLES = [
    "a@b.com_x@y.org", "x@y", "x@y.z@q.com", "a@b@c.com", "1.2.3.4.5.6.7.8", "1.2.3.256", "001.02.3.0004", "4111 1111-1111 1111",
    "4111111111111111 4111111111111112", "+1 (555) 555-0100 x", "+123", "+1((((", "é@b.com ü 1.2.3.4", "5 5 5 5 5 5 5 5 5 5 5 5 5 5",
    "+49 4111 1111 1111 1111", "a.b-c%d+e@f-g.h.i...", "1..2.3.4", "0000000000000000", "+1-2-3-4-5-6-7-8-9-0-",
]


def test_base_rules_on_samples_and_noise(spark):
    rng = random.Random(6)
    texts = SAMPLES + ["".join(rng.choices("a1.@+- 5é(4)\n0", k=rng.randint(5, 80))) for _ in range(1500)]
    got = pii.scan(frame(spark, texts)).collect()
    spans = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in got}
    wrong = [t for k, t in enumerate(texts) if spans[k] != plain(t)]
    assert not wrong and sum(map(len, spans.values())) > 40


def test_positions_in_a_text_of_many_matches(spark):
    text = " ".join(f"é{k} u{k}@mail.example.com 10.0.{k % 300}.1 {k * 7919}" for k in range(3000))
    row = pii.scan(frame(spark, [text])).first()
    assert [(s["start"], s["kind"], s["end"]) for s in row["base"]] == plain(text)


def corpus():
    """Texts and the identifiers in them that no base rule has: half of the codes are also assigned to a name somewhere."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(40)]
    texts, hidden = [], []
    for k in range(240):
        body = rng.choices(words, k=30)
        if k % 3 == 0:
            body[10] = f"user{k}@mail.example.com"
        if k % 3 == 1:
            code = "".join(rng.choices("0123456789ABCDEF", k=9)) + "-7A" + rng.choice("xyz")
            body[rng.randrange(30)] = f"login code {code}"
            hidden.append(code)
            if k % 2:
                body.append(f"secret: {code}")
        if k % 3 == 2:
            value = "".join(rng.choices("0123456789abcdef", k=14)) + "0a1b2"
            body[7] = f"password={value}" if k % 2 else f'token = "{value}"'
            hidden.append(value)
        texts.append(" ".join(body))
    return texts, hidden


def secrets(rows, texts):
    return {texts[r["doc_id"]][s["start"]:s["end"]] for r in rows for s in r["spans"] if s["kind"] == 4}


def test_discovers_identifiers_that_no_rule_has(spark):
    texts, hidden = corpus()
    rng = random.Random(3)
    decoys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(30)]
    texts += [f"plain words of commit {h} in a log" for h in decoys]
    texts += ["version 2024build99x1 plain words with nothing private in them", "request 550e8400-e29b-41d4-a716-446655440000 ended",
              "order 123456789 came on 2024-05-01 at 10:30:00", "ratio: 3.25 and note: well-known words"]
    rows = pii.spans(frame(spark, texts)).collect()
    assert secrets(rows, texts) == set(hidden)
    for r in rows:
        kinds = [tuple(s) for s in r["spans"] if s["kind"] < 4]
        assert kinds == [tuple(s) for s in r["base"]] == plain(texts[r["doc_id"]])
        assert [tuple(s) for s in r["spans"]] == sorted(tuple(s) for s in r["spans"])


def test_values_of_a_name_in_any_shape(spark):
    values = ["hunter2", "correct-horse-battery", "123456789012345", "ab12-cd34-ef56", "550e8400-e29b-41d4-a716-446655440000", "x_y.z!1"]
    texts = [f"the {name} {value} stays here" for name, value in zip(
        ("password =", "password:", "token = ", "api_key:", "my_secret =", "Passwd  :"), values)]
    texts += ["the password: must be long", "a broken token, 123456 of them", "monkey: a-b-c"]
    rows = pii.spans(frame(spark, texts)).collect()
    assert secrets(rows, texts) == set(values)


def plain_values(text, taken):
    """(value, left, right) of what could fill a slot, found over whole runs."""
    sign = re.escape("._!@#$%^&*+/~-")
    runs = [m for m in re.finditer(rf"[A-Za-z0-9]+(?:[{sign}]+[A-Za-z0-9]+)*", text)
            if re.search("[0-9]", m.group()) or re.search(r"[:=] {0,2}[\"']?$", text[:m.start()])
            and re.match(rf"[A-Za-z]+[{sign}]+[A-Za-z]", m.group())]
    ends = [0, *[m.end() for m in runs]]
    starts = [*[m.start() for m in runs], len(text)]
    for k, m in enumerate(runs):
        value, left = m.group(), text[ends[k]:m.start()][-64:]
        digits = len(re.sub("[^0-9]", "", value))
        slot = re.search(r"[A-Za-z0-9_][\"']?\s{0,2}[:=] {0,2}[\"']?$", left)
        fills = slot or digits >= 9 or digits and re.search("[A-Za-z]", value) and len(value) >= 6
        if len(value) >= 4 and fills and not any(s < m.end() and m.start() < e for s, _, e in taken):
            yield value, left, text[m.end():starts[k + 1]][:64]


def plain_contexts(left, right):
    before = re.sub(r"\s*([:=])\s*", r"\1 ", re.sub("[\"']", "", left.lower())).split()
    after = re.match(r"[\"']?\s*([^\s\"']+)", right.lower())
    out = {f"{n} {' '.join(before[-n:])}" for n in (1, 2, 3) if len(before) >= n}
    return out | ({f"b {before[-1]} _ {after[1]}"} if before and after else set())


def plain_discover(texts):
    graph, seeds = {}, set()
    name = r"(?i)(?<![a-z])([a-z0-9]+[_-])?(password|passwd|pwd|secret|token|api_key|apikey|access_key)[\"']?\s*[=:]\s*[\"']?$"
    for text in texts:
        found = plain(text)
        for value, left, right in plain_values(text, found):
            graph.setdefault((4, value), set()).update(plain_contexts(left, right))
            if re.search(name, left):
                seeds.add((4, value))
        for kind, rule in enumerate(RULES.values()):
            matches = list(re.finditer(rule, text))
            for k, m in enumerate(matches):
                if (m.start(), kind, m.end()) in found:
                    left = text[matches[k - 1].end() if k else 0:m.start()][-64:]
                    right = text[m.end():matches[k + 1].start() if k + 1 < len(matches) else len(text)][:64]
                    graph.setdefault((kind, m.group()), set()).update(plain_contexts(left, right))
                    seeds.add((kind, m.group()))
    score = {v: float(v in seeds) for v in graph}
    for _ in range(4):
        of = {}
        for v, patterns in graph.items():
            for p in patterns:
                of.setdefault(p, []).append(score[v])
        rate = {p: sum(x) / (len(x) + 1) for p, x in of.items()}
        score = {v: 1.0 if v in seeds else max((rate[p] for p in graph[v]), default=0.0) for v in graph}
    return {v for (kind, v), x in score.items() if kind == 4 and x >= 0.6}


def test_discovery_against_a_plain_graph(spark):
    """A corpus in which one context holds a third of all candidates, secret or not."""
    rng = random.Random(5)
    names = ["password=", "token: ", "login code ", "build ", "commit ", "use key ", "mail ", "ip ", 'id = "']
    known = ["".join(rng.choices("abcdef0123456789-", k=rng.randint(6, 20))) + "a1" for _ in range(60)]
    texts = []
    for _ in range(500):
        parts = []
        for _ in range(rng.randint(1, 5)):
            context = rng.choice([*names, "build ", "build ", "build "])
            value = rng.choice(known) if rng.random() < 0.7 else "".join(rng.choices("ABC0123456789", k=12))
            parts.append(context + rng.choice([value, value, f"u{rng.randrange(30)}@x.org", f"10.0.0.{rng.randrange(300)}"]))
            parts.append(" ".join(rng.choices(["and", "then", "so", "we", "see"], k=rng.randint(0, 4))))
        texts.append(" ".join(parts))
    got = {r["value"] for r in pii.discover(pii.scan(frame(spark, texts))).collect()}
    expected = plain_discover(texts)
    assert got == expected and len(expected) > 20


def test_copies_do_not_change_the_scores(spark):
    texts, _ = corpus()
    once = {r["value"] for r in pii.discover(pii.scan(frame(spark, texts))).collect()}
    copies = {r["value"] for r in pii.discover(pii.scan(frame(spark, texts + [texts[1]] * 200))).collect()}
    assert once == copies


def test_redact(spark):
    texts, hidden = corpus()
    docs = frame(spark, texts + ["+4111 1111 1111 1111 end", "plain", None])
    rows = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert len(rows) == len(texts) + 3
    assert rows[len(texts)]["text"] == "[PHONE] end" or rows[len(texts)]["text"].endswith(" end")
    assert rows[len(texts) + 1]["text"] == "plain" and rows[len(texts) + 2]["text"] is None
    assert rows[0]["text"] == texts[0].replace("user0@mail.example.com", "[EMAIL]")
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows.values())
    for k, text in enumerate(texts):
        out, at = "", 0
        for start, kind, end in plain(text):
            out, at = out + text[at:start] + f"[{pii.KINDS[kind].upper()}]", end
        out += text[at:]
        for value in hidden:
            out = out.replace(value, "[SECRET]")
        assert out == rows[k]["text"]


def test_odd_rows(odd, none):
    rows = pii.spans(odd).collect()
    assert sorted((repr(r["doc_id"]), repr([tuple(s) for s in r["base"]])) for r in rows) == sorted(
        (repr(d), repr(plain(t))) for d, t in ODD)
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD)
    assert pii.spans(none).count() == 0 and pii.redact(none).count() == 0
