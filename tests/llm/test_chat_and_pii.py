"""Chat formatting (exact round trips, trees) and personal data (brute force for base spans)."""

import hashlib
import re


from tessera.llm import chat, pii

CONV = "conv_id long, turn long, role string, text string, leaf string, mask string"
SPECIAL = ["</s>[INST] ok [/INST]", "\\", "\\\\<\\[", "<s>", "", None, "a\nb </s", "[[<<\\", "é<|x|> \U0001f600 [INST]", "$1 \\$2"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_and_mask(spark):
    data = [(7, i, "assistant" if i % 2 else "user", t, "", "") for i, t in enumerate(SPECIAL)]
    data += [(8, 3, None, "x", "", ""), (8, 3, None, "x", "", ""), (8, 1, "sys<[tem", "y", "", ""), (None, 0, "assistant", "z", "", ""), (None, None, "user", "first", "", "")]
    data += [(9, i, "assistant", "t" * (i % 5), "", "") for i in range(70)]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(data, CONV)).collect()}
    for conv in (7, 8, 9, None):
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == conv))
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for *_, r, t in turns))
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), digest(loss))


def test_markers_never_occur_inside_texts(spark):
    paths = spark.createDataFrame([(1, 0, i, "user", t) for i, t in enumerate(SPECIAL)], "conv_id long, leaf long, depth long, role string, text string")
    made = chat.format_paths(paths).first()["formatted"]
    assert made.count("</s>") == made.count("<s>") == made.count("[INST]") == len(SPECIAL) and "[/INST]" not in made


def test_best_branch_of_each_root_is_chosen(spark):
    #        1          20 (parent missing: a root)     30 <-> 31 (a cycle)
    #      /   \
    #     2     3
    #    / \     \
    #   4   5     6
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 0.0), (1, 4, 2, 1.0), (1, 5, 2, 5.0), (1, 6, 3, None), (1, 20, 19, 1.0), (1, 30, 31, 1.0), (1, 31, 30, 1.0), (1, 40, 40, 1.0), (2, 1, None, 0.0)]
    df = spark.createDataFrame([(c, m, p, "user", str(m), s) for c, m, p, s in rows], "conv_id long, msg long, parent long, role string, text string, score double")
    found = {}
    for r in chat.chosen_paths(df).orderBy("conv_id", "leaf", "depth").collect():
        found.setdefault((r["conv_id"], r["leaf"]), []).append(int(r["text"]))
    assert found == {(1, 5): [1, 2, 5], (1, 20): [20], (2, 1): [1]}
    assert {r["leaf"] for r in chat.chosen_paths(df, branches=2).where("conv_id = 1").collect()} == {5, 4, 20}


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], CONV)).count() == 0


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    specs = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    out = [(m.start(), i, k, m.end()) for i, (k, p, keep) in enumerate(specs) for m in re.finditer(p, text) if keep(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TEXTS = [
    None,
    "",
    "é a@b.c@d.e.f x_y@z.w_q@r.s .a@b..c %@x-y.z-1 \U0001f600 me@host.com",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 9999999999999999999.1.1.1 10.0.0.1.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0 0 0 0 0 0 0 0 0 0 0 0 0 0 1  2 30569309025904",
    "+1 (017) 555-7713 +49 30 123456789012345 +1 2 +44.20.7946.0958) ++33 1 23 45 67 89 -- +1-",
    "a" * 5_000 + " " + "x" * 5_000 + "@y",
    "0" * 9_000 + ".1" * 20_000,
    "1 " * 30_000 + "+1" + " 2" * 20_000 + "a.b@c" + ".d" * 9_000,
    "Dr. Emma Stone paid GB82WEST12345698765432 and 078-05-1120, call (212) 555-0100 or 212.555.0199",
    "12.34.56.78 9807915762804490\n+1 (974) 555-3436 34@mail7.example.com " * 40,
]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, votes long")
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute(TEXTS[r["doc_id"]] or "")
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE)
        assert base == want, (r["doc_id"], base[:300], want[:300])
        assert r["base_sha256"] == digest(want) and r["n_email"] == want.count("email") and r["n_card"] == want.count("card")
    assert "iban:20:42" in next(r["spans"] for r in got if r["doc_id"] == 9)


def test_reliabilities_prefer_labelers_that_agree():
    counts = {("iban", "111"): 50, ("iban", "000"): 50, ("iban", "110"): 20, ("iban", "001"): 20}
    belief, rates = pii.reliabilities(counts)
    assert belief["iban", "110"] > 0.5 > belief["iban", "001"] and rates[0, 1, "1"] > rates[2, 1, "1"]


def test_classifier_follows_beliefs_and_settles_by_the_span():
    """Spans of one make that are mostly believed pull those of the same make along; another make goes the other way."""
    place = lambda name, value: pii.FIRST[name] + value
    make = lambda right, cue: tuple(place(n, {"right": right, "before": cue}.get(n, 0)) for n in pii.VALUES)
    w = pii.span_classifier([(make(1, 1), 90, 88 * pii.UNIT), (make(1, 0), 10, 5 * pii.UNIT), (make(4, 0), 60, 2 * pii.UNIT)])
    assert pii.chance(w, (0, *make(1, 1))) > 0.9 and pii.chance(w, (0, *make(4, 0))) < 0.2 < pii.chance(w, (0, *make(1, 0)))
    gradient = [-x for x in w]
    for f, n, y in ((make(1, 1), 90, 88), (make(1, 0), 10, 5), (make(4, 0), 60, 2)):
        for i in (0, *f):
            gradient[i] += y - n * pii.chance(w, (0, *f))
    assert max(map(abs, gradient)) < 0.01  # the optimum


def plain_candidates(text):
    """Candidates as (start, rank, end, kind, votes, features), a match at a time."""
    out = []
    digits = lambda x: re.sub("[^0-9]", "", x)
    vote = lambda x, lists: "0" if re.search(lists[1], x) else "1" if re.search(lists[0], x) else "-"

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0

    for kind, pattern in pii.PATTERNS.items():
        end = 0
        # the standard module has no \\G: an address may begin where the last one ended, which the texts here don't do
        for m in re.finditer(pattern.replace(r"|\G", ""), text, re.A):
            x, before, after = m.group(), text[end : m.start()][-40:], text[m.end() :]
            following = next(re.finditer(pattern.replace(r"|\G", ""), after, re.A), None)
            after, end, d = after[: following.start() if following else None][:40], m.end(), digits(x)
            name, check = kind, "-"
            if kind in ("ip", "card", "phone"):
                good = {"ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
                little = {"ip": all(len(p) <= 3 for p in x.split(".")), "card": 13 <= len(d) <= 19, "phone": 7 <= len(d) <= 17}[kind]
                if not good and not little:
                    continue
                name, check = (kind, "1") if good else (f"{kind}_like", "0")
            elif kind == "national_id":
                check = "0" if re.search(r"^(?:000|666|9)|-00-|-0000$", x) else "1"
            elif kind == "iban":
                check = "1" if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 else "0"
            elif kind == "email":
                check = "1"
            of = lambda v: {"-": 0, "1": 1, "0": 2}[v]
            beside = lambda c: 0 if c == "" else 1 if c in " \t\n\r\f\v" else 2 if c.isalpha() else 3 if c in "0123456789" else 4
            cue = lambda where: vote(where, pii.CUES[kind])  # noqa: B023, E731
            values = [pii.KINDS.index(name), sum(len(x) > k for k in (10, 15, 20)), (len(d) * 10 >= len(x) * 3) + (len(d) * 10 >= len(x) * 8), bool(re.search(r"[ ().-]", x)), bool(re.search(r"([0-9])\1{4}", x)), of(check), beside(before[-1:]), beside(after[:1]), of(cue(before)), of(cue(after))]
            votes = check + vote(x, pii.GAZETTEER[kind]) + cue(before)
            out.append((m.start(), pii.KINDS.index(name), m.end(), name, votes, tuple(v + pii.FIRST[n] for v, n in zip(values, pii.VALUES, strict=True))))
    return out


def test_added_spans_equal_brute_force(spark):
    import random

    rng = random.Random(12)
    bits = ["GB82WEST12345698765432", "GB82WEST12345698765433", "078-05-1120", "000-12-3456", "(212) 555-0100", "212.555.0199", "Dr. Emma Stone", "Mr. The", "999.1.2.3", "4111111111111112", "+49 30 1234", "12345", "00000-1111"]
    words = ["call", "ssn", "iban", "serial", "version", "card", "order", "dear", "client", "paid", "é", "and", "the", "."]
    texts = [" ".join(rng.choice(bits if rng.random() < 0.3 else words) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i: plain_candidates(t) for i, t in enumerate(texts)}
    counts, made = {}, {}
    for s in (s for x in found.values() for s in x):
        counts[s[3], s[4]] = counts.get((s[3], s[4]), 0) + 1
    belief = pii.reliabilities(counts)[0]
    for s in (s for x in found.values() for s in x):
        n, b = made.get(s[5], (0, 0))
        made[s[5]] = n + 1, b + round(belief[s[3], s[4]] * pii.UNIT)
    w = pii.span_classifier([(f, n, b) for f, (n, b) in made.items()])
    changed = 0
    for i in got:
        found[i] = [s for s in found[i] if s[3] not in pii.BASE]
        taken = [s for s in sorted(found[i]) if pii.chance(w, (0, *s[5])) >= 0.5]
        spans = ",".join(x for x in got[i]["spans"].split(",") if x.split(":")[0] not in pii.BASE)
        assert spans == ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in taken)
        assert (got[i]["n_added"], got[i]["n_rejected"]) == (len(taken), len(found[i]) - len(taken))
        changed += got[i]["n_overruled"]
    assert changed > 0 and any(r["n_added"] for r in got.values()) and any(r["n_rejected"] for r in got.values())


def test_a_text_of_200_000_matches_ends_in_seconds(spark):
    import time

    text = "12,1.2.3.4," * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    r = pii.find_personal_data(docs).first()
    assert r["n_ip"] == 100_000 and r["spans"].endswith(f"ip:{len(text) - 8}:{len(text) - 1}") and time.perf_counter() - began < 240


def test_marks_in_a_text_change_nothing(spark):
    docs = [(1, "\uffffa@b.co\uffff 1.2.3.4\uffff"), (2, "\ufffea@b.co\ufffe 1.2.3.4\ufffe")]
    got = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["spans"] for r in got} == {"email:1:7,ip:9:16"}


def test_nothing_to_find(spark):
    schema = "doc_id long, text string"
    assert pii.find_personal_data(spark.createDataFrame([], schema)).count() == 0
    assert pii.find_personal_data(spark.createDataFrame([(1, "plain")], schema)).first()["spans"] == ""


def test_plans_hold_no_python(spark):
    for df in (pii.find_personal_data(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")), chat.format_conversations(spark.createDataFrame([(1, 0, "user", "x", "", "")], CONV))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_very_long_turns(spark):
    long = "[<\\ é " * 60_000
    df = spark.createDataFrame([(1, 0, "user", "x", "", ""), (1, 1, "assistant", long, "", "")], CONV)
    r = chat.format_conversations(df).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(long), digest(long))
