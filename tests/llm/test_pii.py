"""Surrogates: type, format, coreference, distinctness."""
import random
import re

import pytest

from llm_fixtures import docs  # noqa: F401
from reviewlens.llm import pii

TEXTS = [
    (0, "Call +1 (017) 555-7713 or (017) 555-7713, 017-555-7713."),
    (1, "mail thinst.55@mail9.example.com and THINST.55@MAIL9.EXAMPLE.COM, é.12@mail9.example.com"),
    (2, "card 4111 1111 1111 1111 or 4111111111111111 vs 9807915762804490"),
    (3, "ip 97.51.17.173 and 8.8.8.8 but not 1.2.3 nor 300.1.2.3"),
    (4, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" TOKEN = "B44E15E09FD311C3CF3163B66D5A9875B883D8CE"'),
    (5, "Mr. John Smith met Mary Smith and Frau Müller; Анна Петрова"),
    (6, "nothing here"), (7, None), (8, ""), (9, "ssn 123-45-6789"), (None, "mail thinst.55@mail9.example.com"),
    (9, "ssn 123-45-6789"),
]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


@pytest.fixture(scope="module")
def replaced(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id bigint, text string, m string")
    out = pii.replace_pii(df, "a key", mark="n")
    assert out.columns == ["doc_id", "text", "m", "n"]
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    return {r["doc_id"]: (r["text"], r["n"]) for r in rows}


def test_untouched_texts(replaced):
    assert replaced[6] == ("nothing here", 0) and replaced[7] == (None, 0) and replaced[8] == ("", 0)


def test_phone_mentions_agree_and_keep_their_format(replaced):
    text, n = replaced[0]
    found = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \((\d{3})\) (\d{3})-(\d{4}), (\d{3})-(\d{3})-(\d{4})\.", text)
    parts = found.groups()
    assert n == 3 and parts[:3] == parts[3:6] == parts[6:] and parts[:3] != ("017", "555", "7713")


def test_mail(replaced):
    a, b, c = re.findall(r"\S+@[\w.]+", replaced[1][0])
    assert a.upper() == b and a != "thinst.55@mail9.example.com"
    assert a.split("@")[1] == c.split("@")[1].rstrip(",") and a.endswith(".com")
    assert re.fullmatch(r"[a-z]{6}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", a)
    assert replaced[None][0] == f"mail {a}"


def test_cards_keep_their_check_digit(replaced):
    a, b, c = re.findall(r"(?:\d{4} ?){4}", replaced[2][0])
    assert a.replace(" ", "") == b.strip() != "4111111111111111" and luhn(b.strip()) and a[0] == "4"
    # sixteen digits that fail the check are no card
    assert c == "9807915762804490" and not luhn(c)


def test_ip(replaced):
    found = re.fullmatch(r"ip (\d\d\.\d\d\.\d\d\.\d{3}) and (\d\.\d\.\d\.\d) but not 1\.2\.3 nor 300\.1\.2\.3", replaced[3][0])
    assert found and found[1] != "97.51.17.173" and all(int(x) < 256 for x in found[1].split("."))


def test_secret_stays_hexadecimal(replaced):
    a, b = re.findall(r'"([0-9a-fA-F]{40})"', replaced[4][0])
    assert a.upper() == b and a != "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"


def test_the_whole_secret_goes(docs):
    long = "".join("0123456789abcdef"[(i * 7 + i // 16) % 16] for i in range(200))
    base64 = "ab/cd+ef9Kq3Zt/0Lm+PwX7sRvYg=="
    rows = [(0, f'token="{long}" end'), (1, f'{{"token": "{long}"}}'), (2, f"secret={base64}, x"),
            (3, f"password: {'7' * 200}"), (4, "api_key = aaaabbbb.ccccdddd.eeeeffff. Next"), (5, "token=0123456789abcde."),
            (6, "token=" + "x9" * 2_000)]
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs(rows), "k").collect()}
    made = re.fullmatch(r'token="([0-9a-f]{200})" end', out[0])[1]
    assert out[1] == f'{{"token": "{made}"}}'
    # no long piece of a secret is left
    assert not any(long[i:i + 16] in made for i in range(185))
    code = re.fullmatch(r"secret=(\w\w/\w\w\+\w{8}/\w{3}\+\w{9}==), x", out[2])[1]
    assert sum(a == b for a, b in zip(code, base64, strict=True) if a.isalnum()) < 10
    digits = re.fullmatch(r"password: (\d{200})", out[3])[1]
    assert "7" * 16 not in digits
    assert re.fullmatch(r"api_key = [a-z]{8}\.[a-z]{8}\.[a-z]{8}\. Next", out[4]) and "cccc" not in out[4]
    assert out[5] == rows[5][1]
    assert len(out[6]) == len(rows[6][1]) and "x9" * 8 not in out[6]


def test_names_keep_gender_script_and_coreference(replaced):
    text = replaced[5][0]
    found = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+) (\w+) and Frau (\w+); (\w+) (\w+)", text)
    john, smith, mary, smith2, mueller, anna, petrova = found.groups()
    assert smith == smith2 and smith not in ("Smith", mueller)
    assert john in pii.GIVEN["male_latin"] and john != "John"
    assert mary in pii.GIVEN["female_latin"] and mary != "Mary"
    assert anna in pii.GIVEN["female_cyrillic"] and re.fullmatch(r"[А-Я][а-я]{6}", petrova) and petrova != "Петрова"


def test_the_key_matters(docs):
    a, b = (pii.replace_pii(docs(TEXTS[:1]), key).first()["text"] for key in ("one", "two"))
    assert a != b


def test_collisions_are_drawn_again(docs):
    # 40 addresses in a space of 26 * 26 one-letter names collide and hit real ones
    rows = [(i, f"x {a}@{b}.io y {a.upper()}@{b}.io") for i, (a, b) in
            enumerate((a, b) for a in "bcdfghjkl" for b in "mnpqr")]
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs(rows), "k").collect()}
    real = {t.split()[1] for _, t in rows}
    made = {i: out[i].split()[1] for i, _ in rows}
    assert len(set(made.values())) == len(rows) and not set(made.values()) & real
    assert all(out[i].split()[3] == made[i].upper().replace(".IO", ".io") or out[i].split()[3].lower() == made[i].lower()
               for i, _ in rows)


def test_few_possible_surrogates_grow(docs):
    rows = [(i, f"mail {c}@b.io") for i, c in enumerate("bcdfghjklmnpqrstvwxyz")]
    out = [r["text"].split()[1].split("@")[0] for r in pii.replace_pii(docs(rows), "k").collect()]
    assert len(set(out)) == len(rows)


def test_exceptions_by_join_give_the_same(docs, monkeypatch):
    rows = [(i, f"mail {a}@b.io") for i, a in enumerate("bcdfghjklmnp")]
    want = sorted(r["text"] for r in pii.replace_pii(docs(rows), "k").collect())
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    assert sorted(r["text"] for r in pii.replace_pii(docs(rows), "k").collect()) == want


def test_empty_table(docs):
    assert pii.replace_pii(docs([]), "k").count() == 0


def test_columns_of_any_name(spark):
    names = ["text_key", "_text_key", "_attempts", "_found", "found", "attempts", "given", "given_key", "doc", "m", "entity"]
    df = spark.createDataFrame([(1, "mail a.b@example.com now", *names)],
                               "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    row = pii.replace_pii(df, "k", mark="n").first()
    assert row["n"] == 1 and "a.b@example.com" not in row["text"] and [row[n] for n in names] == names


def iban_ok(text):
    bare = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def one(docs, *texts):
    rows = pii.replace_pii(docs(list(enumerate(texts))), "k", mark="n").collect()
    return [(r["text"], r["n"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_numbers_that_fail_their_check_stay(docs):
    texts = ["order 1234567890123456 and 4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00 x", "version 1.2.3.4, v1.2.3.4",
             "at 12:34:56 or a::b or std::vector or 1:2:3:4:5:6:7:8:9", "+123 45 or +1234567 12345678901234"]
    assert one(docs, *texts) == [(t, 0) for t in texts]


def test_a_secret_of_digits_is_no_card(docs):
    (text, n), = one(docs, "password: 1234567890123456 and token=DE88370400440532013000")
    assert n == 2 and "1234567890123456" not in text and "DE88370400440532013000" not in text


def test_iban(docs):
    (a, n), (b, _) = one(docs, "pay DE89 3704 0044 0532 0130 00, GB82WEST12345698765432.", "DE89370400440532013000")
    spaced, tight = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d), (GB\d\d[A-Z]{4}\d{14})\.", a).groups()
    assert n == 2 and iban_ok(spaced) and iban_ok(tight) and spaced.replace(" ", "") == b != "DE89370400440532013000"


def test_addresses_of_version_6(docs):
    (text, n), = one(docs, "from 2001:0db8:85a3:0000:0000:8a2e:0370:7334, fe80::1ff:FE23:4567 and FE80::1FF:fe23:4567")
    hexes = r"([0-9a-f]{4}(?::[0-9a-f]{4}){7}), ([0-9a-f]{4}::[0-9a-f]{3}:[0-9A-F]{4}:[0-9a-f]{4}) and (\S+)"
    found = re.fullmatch(f"from {hexes}", text)
    assert n == 3 and found[2].lower() == found[3].lower() and "8a2e" not in text and "4567" not in text


def test_international_phones(docs):
    (text, n), (same, _) = one(docs, "+44 20 7946 0958 or +33 1 42 68 53 00, +49 (30) 901820", "call +442079460958 now")
    found = re.fullmatch(r"\+44 (\d\d \d{4} \d{4}) or \+33 (\d(?: \d\d){4}), \+49 \((\d\d)\) (\d{6})", text)
    assert n == 3 and found[1].replace(" ", "") != "2079460958" and found[2] != "1 42 68 53 00"
    assert same == f"call +44{found[1].replace(' ', '')} now"


def test_names_by_context(docs):
    texts = ["My name is Priya Sharma. Sharma said so, and SHARMA too; Sharmas and sharma stay.", "John Q. Smith met Smith.",
             "Dr. Jane Doe", "JOHN SMITH and Mr. O'Brien-Jones", "Contact Wei Zhang, please", "I am German. Dear Sir, hello",
             "Mrs. J. K. Rowling", "Smith alone"]
    out = one(docs, *texts)
    found = re.fullmatch(r"My name is ([A-Z][a-z]{4}) ([A-Z][a-z]{5})\. (\w+) said so, and (\w+) too; "
                         r"Sharmas and sharma stay\.", out[0][0])
    assert found[2] == found[3] == found[4].title() != "Sharma" and found[1] != "Priya" and out[0][1] == 3
    given, initial, smith, again = re.fullmatch(r"(\w+) (\w)\. (\w+) met (\w+)\.", out[1][0]).groups()
    assert given in pii.GIVEN["male_latin"] and initial != "Q" and smith == again != "Smith"
    assert re.fullmatch(r"Dr\. [A-Z][a-z]{3} [A-Z][a-z]{2}", out[2][0]) and "Jane" not in out[2][0] and "Doe" not in out[2][0]
    upper, brien = re.fullmatch(rf"{given.upper()} ([A-Z]+) and Mr\. ([A-Z]'[A-Z][a-z]{{4}}-[A-Z][a-z]{{4}})", out[3][0]).groups()
    assert upper == smith.upper() and brien != "O'Brien-Jones"
    assert re.fullmatch(r"Contact \w{3} \w{5}, please", out[4][0]) and "Wei" not in out[4][0] and "Zhang" not in out[4][0]
    assert out[5] == (texts[5], 0) and out[7] == (texts[7], 0)
    assert re.fullmatch(r"Mrs\. \w\. \w\. \w{7}", out[6][0]) and "Rowling" not in out[6][0] and "J." not in out[6][0]


def test_composed_texts(docs):
    """Texts put together from plain words, decoys and entities: only the entities change, and keep their shape."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))      # noqa: E731

    def card():
        body = rng.choice("23456") + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"
    entities = [card, iban, lambda: ".".join(str(rng.randrange(10, 256)) for _ in range(4)),
                lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
                lambda: f"u{digits(6)}@mail.example.org", lambda: ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)),
                lambda: f"+44 20 {digits(4)} {digits(4)}", lambda: f"token={rng.randbytes(16).hex()}"]
    decoys = [lambda: next(d for d in iter(lambda: "4" + digits(15), None) if not luhn(d)),
              lambda: next(d for d in iter(lambda: "DE" + digits(20), None) if not iban_ok(d)), lambda: digits(8),
              lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: "version 10.20.30.40", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}"]
    rows, parts = [], {}
    for i in range(60):
        parts[i] = [(kind, rng.choice(entities if kind else decoys)() if kind != "word" else "étion")
                    for kind in (rng.choice(["word", True, False]) for _ in range(20))]
        rows.append((i, " , ".join(p for _, p in parts[i])))
    shape = lambda t: re.sub(r"[a-f0-9]", "9", re.sub("[g-z]", "x", t))         # noqa: E731
    for r in pii.replace_pii(docs(rows), "k", mark="n").collect():
        made = r["text"].split(" , ")
        assert len(made) == 20 and r["n"] == sum(kind is True for kind, _ in parts[r["doc_id"]])
        for (kind, given), new in zip(parts[r["doc_id"]], made, strict=True):
            assert (new != given) == (kind is True), (given, new)
            assert len(new) == len(given) and re.sub(r"\w", "x", new) == re.sub(r"\w", "x", given), (given, new)
            if kind is True and re.fullmatch(r"[2-6]\d{15}", given):
                assert luhn(new)


def test_a_long_text(docs):
    filler = "onre anat in ingor " * 50_000
    (text, n), = one(docs, f"{filler}Mr. Zimmer {filler}Zimmer 4111111111111111")
    assert n == 3 and "Zimmer" not in text and "4111111111111111" not in text and text.startswith(filler)
