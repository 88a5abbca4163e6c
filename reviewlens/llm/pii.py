"""Surrogates for personal data, in DataFrame and SQL expressions only.

Entities, found by a pattern and, where the kind has one, by its check:

* e-mail addresses and secret values behind a key word;
* IPv4 addresses, but not behind a word like "version"; IPv6 addresses of eight
  groups, or of fewer around one "::" (two groups and a digit at least);
* card numbers of a payment issuer's first digit that pass the Luhn check;
* IBANs whose check digits hold (remainder 1 by 97);
* phone numbers of ten digits in three groups, and international ones (a plus
  and 8 to 15 digits); social security numbers;
* person names by their context: behind a title, a given name or its capitals,
  initials in between, or a phrase by which people are introduced.  A given name that
  is in no list is replaced letter by letter, as a surname is.  A surname is
  carried through its document: later and earlier bare mentions go, too.

Each gets a keyed surrogate of its own kind:

* format: separators, lengths, letter case and top-level domains stay; a digit
  becomes a digit, a vowel a vowel, an octet an octet of as many digits; card
  numbers and IBANs pass their checks; an IBAN keeps its country, a phone number
  its country code;
* script: a letter becomes a letter of its own script;
* gender: a given name becomes one of the same gender and script by a keyed
  permutation of the list it comes from; titles stay;
* coreference: the surrogate is a function of the key and the entity's
  canonical form (lower case; a phone number without its country code; a domain
  and a surname by themselves), so all mentions in all documents agree;
* distinctness: the distinct canonical forms of the corpus are checked; if two
  share a surrogate or one equals a real entity, all but the smallest are drawn
  again, ``attempt`` by ``attempt``, until none is left.  After ``SAME_LENGTH``
  attempts a surrogate grows by a character, so the loop ends.

Only the distinct entities and the few that were drawn again are shuffled:
a surrogate is computed where its text is read, and a document is joined only
to its own exceptions, so an entity that fills a third of the corpus costs no
more than another.

Defined cases: a NULL text stays NULL, an empty one empty; documents with a
NULL or repeated id are rewritten by their text, repeated rows alike; further
columns are kept, whatever their names; an empty table gives an empty result.
What looks like a card number, an IBAN or an IPv6 address and fails its check
stays as it is, and nothing else is looked for within it.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, written

SAME_LENGTH = 8
BROADCAST_ROWS = 10_000     # documents with exceptions, each with a few short strings

# What is looked for (Java patterns), in order of precedence.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame Mme Г-н Г-жа".split()
GIVEN = {
    "male_latin": ("John James Robert Michael William David Thomas Charles Daniel Matthew Anthony Peter Klaus "
                   "Jürgen Wolfgang Stefan Pierre Jacques François Carlos José Miguel Javier Diego Hans").split(),
    "female_latin": ("Mary Patricia Jennifer Elizabeth Barbara Susan Jessica Sarah Margaret Emily Helga Ursula "
                     "Ingrid Sabine Brigitte Claire Sophie Camille Carmen Lucía Isabel Teresa Pilar Anna Maria").split(),
    "male_cyrillic": "Иван Дмитрий Сергей Алексей Николай Михаил Владимир Андрей".split(),
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
}
INITIALS = [f"{c}." for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"], [f"{c}." for c in "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"]
# phrases before a name: of one word or more, of two or more
NAMED = "name is|heiße|m'appelle|llamo|зовут"
INTRODUCED = "I am|I'm|ame:|igned by|ontact|egards,|incerely,|ich bin|je suis|soy|Dear"
NOT_ADDRESSES = "ersion|elease|uild|ection|hapter"      # what stands before four numbers with dots


def _either(words) -> str:
    """The words and their capitals, as alternatives."""
    return "|".join(dict.fromkeys([*words, *(w.upper() for w in words)]))


_NAMES = [n for names in GIVEN.values() for n in names]
_NAME_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_UPPER_WORD = r"(?:\p{Lu}['’])?\p{Lu}{2,}+(?:-\p{Lu}{2,}+)?"
_BETWEEN = r"(?: [A-ZА-Я]\.){0,2} "
_FULL = f"{_NAME_WORD}(?:{_BETWEEN}{_NAME_WORD})"
_WORD_START, _WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}])"
# the first letter is left out of key words and phrases that begin with a small or a capital one
SECRET_WORDS = "oken TOKEN ecret SECRET assword PASSWORD api_key API_KEY".split()
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    # the whole run, of 16 characters at least; a full stop behind it is none of it
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f]{0,4}+:[0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}"
            r"(?![\p{L}\p{N}:]|\.[0-9])",
    "secret": rf"(?=[A-Za-z0-9_/+-])(?<=(?:{'|'.join(SECRET_WORDS)})[\"']?[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?)"
              r"[A-Za-z0-9_./+=-]{15,}[A-Za-z0-9_/+=-]",
    "ip": rf"(?<![\p{{N}}.]|(?:{NOT_ADDRESSES})s? |[vV])"
          r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
          r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}])(?:[2-6][0-9]{3}[ -]?(?:[0-9]{4}[ -]?){2}[0-9]{4}[0-9]{0,3}"
            r"|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
             r"|\+[1-9](?:[0-9]{7,14}|[0-9]{0,2}(?:[ .-](?:\([0-9]{1,5}\)|[0-9]{1,8})){2,6}))(?![\p{L}\p{N}])",
    "name": rf"(?:(?<=(?:{NAMED}) ){_NAME_WORD}(?:{_BETWEEN}{_NAME_WORD}){{0,2}}"
            rf"|(?<=(?:{INTRODUCED}) )(?!(?:{'|'.join(TITLES)})\b){_FULL}"
            rf"|{_WORD_START}(?:(?:{_either(TITLES)})\.?{_BETWEEN}(?:{_FULL}|{_NAME_WORD}|{_UPPER_WORD}(?: {_UPPER_WORD})?)"
            rf"|(?:{_either(_NAMES)}){_BETWEEN}(?:{_NAME_WORD}|{_UPPER_WORD}))){_WORD_END}",
}
# a country's calling code at the head of an international number
CALLING_CODE = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_BARE_WORD = rf"{_WORD_START}(?:\p{{Lu}}['’])?\p{{Lu}}\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)?{_WORD_END}"


def pattern(*kinds: str) -> str:
    """The kinds that begin with a digit and names, which one look at a character mostly rules
    out, behind the more costly ``kinds``.  A secret is group 1."""
    dear = [f"({PATTERNS[k]})" if k == "secret" else f"(?:{PATTERNS[k]})" for k in kinds]
    digits = "|".join(PATTERNS[k] for k in ("ip", "card", "ssn", "phone"))
    return "|".join([*dear, f"(?=[0-9+(])(?:{digits})", f"(?=\\p{{Lu}})(?:{PATTERNS['iban']}|{PATTERNS['name']})"])


# Letters that stand for each other, by script.
SCRIPTS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñý",
           "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is then evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _stream(seed: str, length: str) -> str:
    """SQL: enough hex digits, eight for each of ``length`` characters, in an array of 64 each."""
    return f"transform(sequence(0, cast(({length}) div 8 as int)), b -> sha2(concat({seed}, '/', b), 256))"


def _number(at: str = "i") -> str:
    """SQL: the number at a character's place of the stream ``s``."""
    return f"cast(conv(substring(s[{at} div 8], 8 * ({at} % 8) + 1, 8), 16, 10) as bigint)"


def _substituted(text: str, seed: str) -> str:
    """SQL: each character of lower-case ``text`` replaced within its script."""
    new = _let("a", f"get(filter({SCRIPTS_SQL}, a -> instr(a, c) > 0), 0)",
               f"if(a is null, c, substring(a, cast({_number()} % length(a) as int) + 1, 1))")
    return _let("s", _stream(seed, f"length({text})"),
                f"array_join(transform(split({text}, ''), (c, i) -> {new}), '')")


def _luhn_sum(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits."""
    double = f"(length({digits}) - i) % 2 = 1"
    digit = f"coalesce(try_cast(substring({digits}, i, 1) as int), 0)"
    return (f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + case when {double} "
            f"then if({digit} > 4, {digit} * 2 - 9, {digit} * 2) else {digit} end)")


def _mod97(text: str) -> str:
    """SQL: the remainder by 97 of lower-case ``text``, letters read as 10 to 35."""
    return (f"aggregate(split({text}, ''), 0, (t, c) -> if(c rlike '[a-z]', (t * 100 + ascii(c) - 87) % 97, "
            f"(t * 10 + coalesce(try_cast(c as int), 0)) % 97))")


def _country(m: str) -> str:
    """SQL: the digits of a phone number's country code, empty if it has none."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return f"if({m} like '+%', regexp_extract({digits}, '{CALLING_CODE}', 1), '')"


SCRIPTS_SQL = f"array({', '.join(map(_literal, SCRIPTS))})"
TITLES_SQL = f"array({', '.join(map(_literal, _either(TITLES).split('|')))})"


def _given_map(key: str) -> str:
    """SQL: a map that moves every given name and initial to another one of its list, a keyed permutation."""
    pairs = {}
    capitals = {f"{kind}/capitals": [n.upper() for n in names] for kind, names in GIVEN.items()}
    initials = {f"initial/{i}": letters for i, letters in enumerate(INITIALS)}
    for kind, names in (GIVEN | capitals | initials).items():
        # a name in capitals goes the way of the name
        kind = kind.removesuffix("/capitals")
        by = {n.upper(): n for n in GIVEN.get(kind, [])}
        shuffled = sorted(names, key=lambda n: hashlib.sha256(f"{key}/{kind}/{by.get(n, n)}".encode()).digest())
        pairs |= zip(shuffled, shuffled[1:] + shuffled[:1], strict=True)
    return (f"map_from_arrays(array({', '.join(map(_literal, pairs))}), "
            f"array({', '.join(map(_literal, pairs.values()))}))")


class Surrogates:
    """The SQL expressions for one secret key.

    A canonical form is 'kind:value', so kinds never meet.
    """

    def __init__(self, key: str):
        self.mac = _literal(hashlib.sha256(b"surrogates/" + key.encode()).hexdigest())
        self.given = _given_map(key)

    @staticmethod
    def kind(m: str) -> str:
        """SQL: the kind of a match that is no secret, 'none' if it fails its kind's check."""
        digits = f"regexp_replace({m}, '[^0-9]', '')"
        groups = f"size(filter(split({m}, ':'), g -> g <> ''))"
        v6 = (f"if(instr({m}, '::') > 0, length({m}) - length(replace({m}, '::', '')) = 2 and {m} not like '%:::%' "
              f"and {m} rlike '[0-9]' and {groups} between 2 and 7, {groups} = 8 and size(split({m}, ':')) = 8)")
        bare = f"lower(replace({m}, ' ', ''))"
        moved = _let("b", bare, f"{_mod97('concat(substring(b, 5), left(b, 4))')} = 1")
        luhn = _let("d", digits, f"{_luhn_sum('d')} % 10 = 0")
        return (f"case when instr({m}, '@') > 0 then 'email' "
                f"when {m} rlike '^[0-9]+([.][0-9]+){{3}}$' then 'ip' "
                f"when {m} rlike '^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$' then if({v6}, 'ipv6', 'none') "
                f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn' "
                f"when {m} rlike '^[A-Z]{{2}}[0-9]{{2}}' then if({moved}, 'iban', 'none') "
                f"when {m} rlike '^[0-9][0-9 -]+$' and length({digits}) >= 15 then if({luhn}, 'card', 'none') "
                f"when {m} rlike '^[0-9(]' then 'phone' "
                f"when {m} like '+%' then if(length({digits}) between 8 and 15, 'phone', 'none') "
                f"else 'name' end")

    def word(self, w: str, i: str) -> str:
        """SQL: what stands for a title or given name; NULL for a surname."""
        return (f"if({i} = 0 and array_contains({TITLES_SQL}, rtrim('.', {w})), {w}, "
                f"element_at({self.given}, {w}))")

    def surnames(self, m: str) -> str:
        """SQL: the words of a name that no list holds, an array."""
        return f"filter(split({m}, ' '), (w, i) -> {self.word('w', 'i')} is null)"

    def entities(self, m: str, k: str) -> str:
        """SQL: the canonical forms in a match of kind ``k``, an array (one for each surname of a name)."""
        digits = f"regexp_replace({m}, '[^0-9]', '')"
        return (f"case {k} when 'none' then cast(array() as array<string>) "
                f"when 'name' then transform({self.surnames(m)}, w -> concat('name:', lower(w))) "
                f"else array(concat({k}, ':', case when {k} in ('ssn', 'card') then {digits} "
                f"when {k} = 'phone' then substring({digits}, length({_country(m)}) + 1) "
                f"when {k} = 'iban' then lower(replace({m}, ' ', '')) else lower({m}) end)) end")

    def surrogate(self, canon: str, attempt: str) -> str:
        """SQL: the surrogate 'kind:value' of a canonical form, the same at every place."""
        more = f"greatest(0, {attempt} - {SAME_LENGTH - 1})"
        host = "left(d, length(d) - length(substring_index(d, '.', -1)))"
        host_seed = f"concat({self.mac}, '/host/', d)"
        local = f"concat(substring_index(v, '@', 1), repeat('a', {more}))"
        email = _let("d", "substring_index(v, '@', -1)", (
            f"concat({_let('l', local, _substituted('l', 'z'))}, '@', {_let('h', host, _substituted('h', host_seed))}, "
            f"substring_index(d, '.', -1))"))
        octet = (f"cast(case when {attempt} >= {SAME_LENGTH} then {_number()} % 256 "
                 f"when length(o) = 1 then {_number()} % 10 when length(o) = 2 then 10 + {_number()} % 90 "
                 f"else 100 + {_number()} % 156 end as string)")
        ip = _let("s", _stream("z", "4"), f"array_join(transform(split(v, '[.]'), (o, i) -> {octet}), '.')")
        drawn = f"concat(left(v, 1), {_let('t', 'substring(g, 2)', _substituted('t', 'z'))})"
        body = _let("e", "concat(left(d, length(d) - 1), '0')",
                    f"concat(left(d, length(d) - 1), cast((10 - {_luhn_sum('e')} % 10) % 10 as string))")
        card = _let("d", drawn, body)
        iban = _let("b", _let("t", "substring(g, 5)", _substituted("t", "z")), (
            f"concat(left(v, 2), lpad(cast(98 - {_mod97("concat(b, left(v, 2), '00')")} as string), 2, '0'), b)"))
        ipv6 = _let("s", _stream("z", "length(g)"), (
            f"array_join(transform(split(g, ''), (c, i) -> case when c = ':' then c "
            f"when c rlike '[0-9]' then substring('0123456789', cast({_number()} % 10 as int) + 1, 1) "
            f"else substring('abcdef', cast({_number()} % 6 as int) + 1, 1) end), '')"))
        grown = f"concat(v, repeat(if(v rlike '^[0-9]', '0', 'a'), {more}))"
        cases = (f"case when k = 'secret' and v rlike '^[0-9a-f]+$' and v rlike '[a-f]' "
                 f"then left(array_join({_stream('z', 'length(g)')}, ''), length(g)) "
                 f"when k = 'email' then {email} when k = 'ip' then {ip} when k = 'card' then {card} "
                 f"when k = 'iban' then {iban} when k = 'ipv6' then {ipv6} "
                 f"else {_substituted('g', 'z')} end")
        return _let("k", f"substring_index({canon}, ':', 1)", _let(
            "v", f"substring({canon}, length(k) + 2)", _let(
                "z", f"concat({self.mac}, '/', {canon}, '/', {attempt})", _let(
                    "g", grown, f"concat(k, ':', {cases})"))))

    @staticmethod
    def _formatted(m: str, value: str, only: str = "") -> str:
        """SQL: ``value`` with the letter case of ``m`` and, where ``only`` names the characters that
        are replaced, its separators; what is longer follows."""
        if only:
            before = f"length(regexp_replace(left({m}, i), '[^{only}]', ''))"
            body = (f"array_join(transform(split({m}, ''), (c, i) -> "
                    f"if(c rlike '[{only}]', substring({value}, {before} + 1, 1), c)), '')")
            return f"concat({body}, substring({value}, length(regexp_replace({m}, '[^{only}]', '')) + 1))"
        cased = (f"array_join(transform(split({value}, ''), (c, i) -> "
                 f"if(get(o, i) <> lower(get(o, i)), upper(c), c)), '')")
        cased = _let("o", f"split({m}, '')", cased)
        return f"if({m} = upper({m}) and {m} <> lower({m}), upper({value}), {cased})"

    def _drawn(self, canon: str, attempts: str, body: str) -> str:
        """SQL: ``body`` with ``y`` standing for the surrogate of ``canon``."""
        return _let("n", canon, _let("q", f"coalesce(element_at({attempts}, n), 0)", _let(
            "x", self.surrogate("n", "q"), _let("y", "substring(x, instr(x, ':') + 1)", body))))

    def surname(self, w: str, attempts: str) -> str:
        """SQL: the text in place of a surname."""
        return self._drawn(f"concat('name:', lower({w}))", attempts, self._formatted(w, "y"))

    def replacement(self, m: str, k: str, attempts: str) -> str:
        """SQL: the text in place of a match of kind ``k``; ``attempts`` maps canonical forms that were drawn again."""
        phone = _let("u", f"concat({_country(m)}, y)", self._formatted(m, "u", "0-9"))
        name = (f"array_join(transform(split({m}, ' '), (w, j) -> "
                f"coalesce({self.word('w', 'j')}, {self.surname('w', attempts)})), ' ')")
        other = self._drawn(f"{self.entities(m, k)}[0]", attempts, (
            f"case when {k} = 'phone' then {phone} when {k} in ('card', 'ssn') then {self._formatted(m, 'y', '0-9')} "
            f"when {k} = 'iban' then upper({self._formatted(m, 'y', 'A-Z0-9')}) "
            f"when {k} = 'ip' then y else {self._formatted(m, 'y')} end"))
        return f"case {k} when 'none' then {m} when 'name' then {name} else {other} end"


def _by_pattern(text: str, make) -> Column:
    """``make(kinds)`` with the dear kinds only in texts that hold their signs."""
    secret = F.lit(False)
    for word in SECRET_WORDS:
        secret = secret | F.contains(F.col(text), F.lit(word))
    signs = {"email": F.contains(F.col(text), F.lit("@")), "secret": secret,
             "ipv6": F.col(text).rlike("[0-9A-Fa-f:]:[0-9A-Fa-f]{0,4}:")}
    out = F
    for n in range(len(signs), 0, -1):
        for kinds in itertools.combinations(signs, n):
            held = F.lit(True)
            for kind in kinds:
                held = held & signs[kind]
            out = out.when(held, make(kinds))
    return out.otherwise(make(()))


def _matches(text: str) -> Column:
    """The matches in a text, an array of (m, k): what was found and its kind."""
    def typed(kinds) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern(*kinds)), F.lit(0))
        if "secret" not in kinds:
            return F.transform(found, lambda m: F.struct(m.alias("m"), F.lit(False).alias("secret")))
        secrets = F.regexp_extract_all(F.col(text), F.lit(pattern(*kinds)), F.lit(1))
        return F.zip_with(found, secrets, lambda m, s: F.struct(m.alias("m"), (F.length(s) > 0).alias("secret")))
    return _by_pattern(text, typed)


def _kinds(found: str) -> Column:
    return F.expr(f"transform({found}, f -> named_struct('m', f.m, 'k', "
                  f"if(f.secret, 'secret', {Surrogates.kind('f.m')})))")


def redrawn(entities: DataFrame, how: Surrogates) -> DataFrame:
    """(entity, attempt > 0): the entities that collided, each with its first free attempt.

    ``entities`` holds each canonical form once, in column ``entity``.
    """
    state = entities.select("entity", F.lit(0).alias("attempt"))
    while True:
        state = written(state.withColumn("mine", F.expr(how.surrogate("entity", "attempt"))), "pii-state")
        real = state.join(state.select(F.col("entity").alias("mine")), "mine", "left_semi").select("entity")
        first = (state.groupBy("mine").agg(F.min("entity").alias("entity"), F.count("*").alias("n"))
                 .filter("n > 1").withColumnRenamed("entity", "holder"))
        later = state.join(first, "mine").filter("entity <> holder").select("entity")
        bad = written(real.unionByName(later).distinct(), "pii-collisions")
        if bad.isEmpty():
            return state.filter("attempt > 0").select("entity", "attempt")
        state = (state.join(bad.withColumn("again", F.lit(1)), "entity", "left")
                 .select("entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")))


def mentions(docs: DataFrame, text_col: str, how: Surrogates) -> DataFrame:
    """(text_key, entity): the canonical forms in each distinct text."""
    found = docs.select(F.xxhash64(f"`{text_col}`").alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    found = found.select("text_key", F.explode(_matches("text")).alias("f"))
    found = found.select("text_key", "f.m", F.expr(f"if(f.secret, 'secret', {how.kind('f.m')})").alias("k"))
    return found.select("text_key", F.explode(F.expr(how.entities("m", "k"))).alias("entity")).distinct()


def _joined(parts: Column, between: Column) -> Column:
    """The pieces of a split text with what goes between them."""
    return F.array_join(F.zip_with(parts, between, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", mark: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; column ``mark`` gets the number of replacements."""
    require(docs, text_col)
    how = Surrogates(key)
    held = written(mentions(docs, text_col, how), "pii-mentions")
    again = redrawn(written(held.select("entity").distinct(), "pii-entities"), how)
    # the exceptions of a document are at most its own entities
    per_text = (held.join(again, "entity").groupBy("text_key")
                .agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("_attempts")))
    per_text = written(per_text, "pii-exceptions")
    if per_text.count() <= BROADCAST_ROWS:
        per_text = F.broadcast(per_text)        # else the texts are shuffled to their exceptions
    # the document's columns are one struct, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.withColumn("given", F.col(f"doc.`{text_col}`")).withColumn("given_key", F.xxhash64("given"))
    rows = rows.join(per_text, F.col("given_key") == F.col("text_key"), "left")
    rows = rows.withColumn("raw", _matches("given")).withColumn(
        "attempts", F.coalesce("_attempts", F.expr("cast(map() as map<string, int>)"))).withColumn("found", _kinds("raw"))
    swapped = F.expr(f"transform(found, f -> {how.replacement('f.m', 'f.k', 'attempts')})")
    parts = _by_pattern("given", lambda kinds: F.split(F.col("given"), pattern(*kinds), -1))
    rows = rows.withColumn("made", F.when(F.size("found") > 0, _joined(parts, swapped)).otherwise(F.col("given")))
    # a surname goes from the whole document: no surrogate equals a real one, so those left are bare mentions
    names = f"flatten(transform(filter(found, f -> f.k = 'name'), f -> {how.surnames('f.m')}))"
    rows = rows.withColumn("names", F.when(F.exists("found", lambda f: f["k"] == "name"), F.expr(
        f"array_distinct(flatten(transform({names}, w -> array(w, upper(w), initcap(lower(w))))))")))
    rows = rows.withColumn("bare", F.when(F.size("names") > 0, F.array_intersect(
        F.regexp_extract_all("made", F.lit(_BARE_WORD), F.lit(0)), "names")))
    rows = rows.withColumn("bare_pattern", F.when(F.size("bare") > 0, F.concat(
        F.lit(f"{_WORD_START}(?:"), F.array_join("bare", "|"), F.lit(f"){_WORD_END}"))))
    rows = rows.withColumn("carried", F.when(F.col("bare_pattern").isNotNull(), F.regexp_extract_all(
        F.col("made"), F.col("bare_pattern"), F.lit(0))))
    again = F.expr(f"transform(carried, w -> {how.surname('w', 'attempts')})")
    text = (F.when(F.col("bare_pattern").isNotNull(), _joined(F.split("made", F.col("bare_pattern"), -1), again))
            .otherwise(F.col("made")))
    out = [text.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    if mark:
        count = "coalesce(size(filter(found, f -> f.k <> 'none')), 0) + coalesce(size(carried), 0)"
        out.append(F.expr(f"if(given is null, 0, {count})").alias(mark))
    return rows.select(*out)
