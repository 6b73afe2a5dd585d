"""Personal data: surrogates in place of detected entities. DataFrame and SQL functions only.

Method. One expression finds e-mail addresses, IBANs, card and account numbers, social security numbers, phone numbers,
IPv4 addresses and names after an honorific: capitalised words or words in capitals, initials, and particles (van, de la)
before a word. Where a document has such names, their words are also found when they stand alone in it, in either case. An entity has a type and a canonical form (digits of a phone number, a name's single words, ...), and its
surrogate is a keyed function of type and form alone: the same entity gets the same surrogate in every document, in
whatever notation and place. Number types go through a four-round Feistel permutation of their digits, which can't map two
numbers of a format to one; card numbers keep their first digit and get a new check digit, account numbers walk on until
they fail the cards' check, IBANs keep their country and get new check digits, phone numbers their country code, addresses
four octets, e-mail addresses their top domain (and people of one domain stay together). Listed given names rotate within
the list of their gender and script; other words of names are composed of syllables in the word's script (Latin, Cyrillic,
Greek, Armenian; words of other scripts get Latin ones) and keep the class of their ending, which tells the gender where
anything does. Names in capitals, apostrophes and capitals within a name stay what they are; initials rotate in their
alphabet, particles stay. Letters, digits, separators, hyphens and the case of e-mail addresses stay where they were.

The key is a parameter. Who has it can undo the permutations of numbers, and so can who reads it from a query's plan; the
query and the pipeline take it from `spark.folioscope.pii.key` and, where that is unset, make one up for their session.

Collision checks run over the distinct entities of the whole corpus: an entity whose surrogate equals another's, or equals
an entity that really occurs, tries the next key of its own until none is left. From the WIDEN-th key on a surrogate also
grows by a syllable, letter or digit a key, since a format can have fewer forms than entities (all ten one-digit mailboxes
of a domain); IPv4 addresses can't grow. Collisions that ATTEMPTS keys leave are an error, never a result. Few entities
ever need a second key; up to LITERAL_LIMIT of them travel as a literal, more by a join on the text's digest.

Defined results. Null and empty texts stay as they are. Texts without entities stay byte for byte. Number runs that fail
their checksum: IBAN-like strings stay, runs of 13 to 19 digits count as account numbers. A name goes on as long as its
words do, so that capitalised words right after it belong to it; bare mentions are whole words, before or after the name.
Initials outside the alphabets of the four scripts count as an X. Numbers without a country code in no format of these
stay. Repeated rows get equal texts. Extra columns pass through;
a column named `entities` is replaced where entities are asked for. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, discard, settle

#: The setting that holds the key of the query and of the pipeline.
KEY_SETTING = "spark.folioscope.pii.key"
#: Entities with keys of their own that still go into the plan as a literal.
LITERAL_LIMIT = 500
#: Keys that an entity may try.
ATTEMPTS = 64
#: Keys that it tries in its own format before its surrogate grows, and by how much that can be at most.
WIDEN, WIDEST = 8, 8

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_NUMBER = r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
#: Honorifics by gender; n: either.
HONORIFICS = {
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"),
    "n": ("Dr", "Prof"),
}
_TITLE = "|".join(sorted((t for ts in HONORIFICS.values() for t in ts), key=len, reverse=True))
#: Particles of names, which stay.
PARTICLES = "af al av ben bin da dal das de dei del della den der des di do dos du el ibn la las le los van vom von y zu zum zur".split()
_WORD = r"(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?|\p{Lu}{2,})"
_INITIAL = r"(?:\p{Lu}\.)+|\p{Lu}(?= \p{Lu})"
_NAME = rf"(?:(?:(?:{'|'.join(PARTICLES)}) )*+{_WORD}|{_INITIAL})(?!\p{{L}})"
# possessive, so that a name of any length is matched in a loop
_PERSON = rf"(?<![\p{{L}}])(?:{_TITLE})\.? {_NAME}(?:[ -]{_NAME})*+"
PATTERN = "|".join((_EMAIL, _IBAN, _NUMBER, _SSN, _PHONE, _IPV4, _PERSON))

#: Given names that rotate, by gender and script.
GIVEN = {
    ("m", "latin"): "James Robert Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter George Henry Walter".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Donna Carol Laura Helen".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Михаил Павел Юрий Олег Игорь".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Людмила Галина Нина Вера".split(),
}
#: Consonants and vowels of composed names by script, endings of women's names, and what closes other names.
SYLLABLES = {
    "latin": ("bcdfghjklmnprstv", "aeiou", "a", "n"),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоу", "ая", "н"),
    "greek": ("βγδζθκλμνπρστφχψ", "αειου", "αη", "ς"),
    "armenian": ("բգդզթլխկհմնպսվտր", "աեիու", "ա", "ն"),
}
#: Country codes of one and two digits; all others have three.
COUNTRY = "(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: The alphabets that initials rotate in.
ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔՕՖ")
#: Steps that an account number may walk until it fails the cards' check: nine in ten numbers do.
WALK = 40
KINDS = ("email", "iban", "card", "account", "ssn", "phone", "ipv4", "person")


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn_sum(d: str) -> str:
    """Of a digit string whose last digit is the check digit."""
    at = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (s, i) -> s + if(i % 2 = 0, {at}, {at} * 2 - if({at} > 4, 9, 0)))"


def _mod97(x: str) -> str:
    """Of a string of digits and capitals."""
    return f"aggregate(transform(sequence(1, length({x})), i -> substr({x}, i, 1)), 0, (r, c) -> if(c between '0' and '9', (r * 10 + ascii(c) - 48) % 97, (r * 100 + ascii(c) - 55) % 97))"


def kind(m: str) -> str:
    d = _digits(m)
    bare = f"replace({m}, ' ', '')"
    iban = f"{_mod97(f'concat(substr({bare}, 5), substr({bare}, 1, 4))')} = 1"
    return f"""CASE WHEN contains({m}, '@') THEN 'email'
      WHEN rlike({m}, '^[A-Z]{{2}}[0-9]{{2}}') THEN if({iban}, 'iban', NULL)
      WHEN rlike({m}, {_q(rf'^{_OCTET}([.]{_OCTET}){{3}}$')}) THEN 'ipv4'
      WHEN rlike({m}, '^[0-9][0-9 -]*$') AND length({d}) >= 13 THEN if({_luhn_sum(d)} % 10 = 0, 'card', 'account')
      WHEN rlike({m}, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') THEN 'ssn'
      WHEN rlike({m}, '^[+(0-9]') THEN 'phone' ELSE 'person' END"""


def _code(m: str) -> str:
    """The country code of a phone number, as written apart or by the list of codes; '' without a plus sign."""
    apart = f"regexp_extract({m}, '^[+]([0-9]{{1,3}})(?=[^0-9])', 1)"
    return f"if(startswith({m}, '+'), if({apart} <> '', {apart}, regexp_extract({m}, {_q('^[+]' + COUNTRY)}, 1)), '')"


def _rest(m: str) -> str:
    """A name without its honorific; a bare word is all of itself."""
    return f"substr({m}, locate(' ', {m}) + 1)"


def _names(m: str) -> str:
    """The words of a name after the honorific."""
    return f"split({_rest(m)}, '[ -]')"


def _is_particle(w: str) -> str:
    return f"{w} IN ({', '.join(map(_q, PARTICLES))})"


def _is_initial(w: str) -> str:
    return f"(length({w}) = 1 OR contains({w}, '.'))"


def _canonical(w: str) -> str:
    """A word of a name in any case, with either apostrophe: one capital, then small letters."""
    return f"replace(concat(substr({w}, 1, 1), lower(substr({w}, 2))), '’', {_q(chr(39))})"


def _as_written(w: str, s: str) -> str:
    """The word s with the capitals and the apostrophe of w."""
    c = f"substr({w}, i, 1)"
    step = f"if(c IN ({_q(chr(39))}, '’'), named_struct('o', concat(t.o, c), 'i', t.i), named_struct('o', concat(t.o, if(c <> lower(c), upper(substr({s}, t.i, 1)), substr({s}, t.i, 1))), 'i', t.i + 1))"
    walked = f"aggregate(transform(sequence(1, length({w})), i -> {c}), named_struct('o', '', 'i', 1), (t, c) -> {step}, t -> concat(t.o, substr({s}, t.i)))"
    return f"if(length({w}) > 1 AND {w} = upper({w}), upper({walked}), {walked})"


def _script(word: str) -> str:
    cases = " ".join(f"WHEN rlike({word}, '^\\\\p{{Is{name.title()}}}') THEN '{name}'" for name in SYLLABLES if name != "latin")
    return f"CASE {cases} ELSE 'latin' END"


def entities(m: str, k: str) -> str:
    """SQL for array<struct<type, form>>: the entities of a match m of kind k."""
    d = _digits(m)
    one = lambda form: f"array(named_struct('type', {k}, 'form', {form}))"
    word = f"named_struct('type', concat('name-', {_script('w')}), 'form', {_canonical('w')})"
    words = f"transform({_names(m)}, w -> CASE WHEN {_is_particle('w')} THEN named_struct('type', 'particle', 'form', w) WHEN {_is_initial('w')} THEN named_struct('type', 'initial', 'form', w) ELSE {word} END)"
    return f"""CASE {k} WHEN 'email' THEN {one(f'lower({m})')} WHEN 'iban' THEN {one(f"replace({m}, ' ', '')")} WHEN 'ipv4' THEN {one(m)}
      WHEN 'phone' THEN {one(f"concat({_code(m)}, '.', substr({d}, length({_code(m)}) + 1))")} WHEN 'person' THEN {words} ELSE {one(d)} END"""


def _hash(*parts: str) -> str:
    """Of the key, which is the first part, and others."""
    return f"sha2(concat_ws('|', {', '.join(parts)}), 256)"


def _number(*parts: str) -> str:
    return f"cast(conv(substr({_hash(*parts)}, 1, 15), 16, 10) as bigint)"


def _feistel(d: str, *tag: str) -> str:
    """A keyed permutation of the digit strings of d's length (2 to 36 digits)."""
    n, u = f"length({d})", f"(length({d}) div 2)"
    power = lambda k: f"cast(pow(10, {k}) as bigint)"
    pair = lambda a, b: f"named_struct('a', {a}, 'b', {b})"
    turn = lambda x: _number(*tag, "cast(r as string)", f"cast({n} as string)", f"cast({x} as string)")
    first = pair(f"cast(substr({d}, 1, {u}) as bigint)", f"cast(substr({d}, {u} + 1) as bigint)")
    left, right = pair(f"pmod(s.a + {turn('s.b')}, {power(u)})", "s.b"), pair("s.a", f"pmod(s.b + {turn('s.a')}, {power(f'({n} - {u})')})")
    done = f"aggregate(sequence(1, 4), {first}, (s, r) -> if(r % 2 = 1, {left}, {right}), s -> concat(lpad(cast(s.a as string), {u}, '0'), lpad(cast(s.b as string), {n} - {u}, '0')))"
    return f"if({n} < 2, {d}, {done})"


def _octets(form: str, *tag: str) -> str:
    """The same permutation on two pairs of octets."""
    o = lambda i: f"cast(split_part({form}, '.', {i}) as bigint)"
    turn = lambda x: _number(*tag, "cast(r as string)", f"cast({x} as string)")
    start = f"named_struct('a', {o(1)} * 256 + {o(2)}, 'b', {o(3)} * 256 + {o(4)})"
    step = f"if(r % 2 = 1, named_struct('a', pmod(s.a + {turn('s.b')}, 65536L), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b + {turn('s.a')}, 65536L)))"
    return f"aggregate(sequence(1, 4), {start}, (s, r) -> {step}, s -> concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256))"


def _pattern(text: str, seed: str) -> str:
    """Digits for digits, letters for letters, by the hexadecimal seed; other characters stay."""
    h = f"cast(conv(substr({seed}, 2 * (i % 31) + 1, 3), 16, 10) as int)"
    c = f"substr({text}, i, 1)"
    return f"""array_join(transform(sequence(1, greatest(1, length({text}))), i -> CASE WHEN {c} between '0' and '9' THEN chr(48 + {h} % 10)
      WHEN {c} between 'a' and 'z' THEN chr(97 + {h} % 26) WHEN {c} between 'A' and 'Z' THEN chr(65 + {h} % 26) ELSE {c} END), '')"""


def _wider(attempt: str) -> str:
    """By how many syllables, letters or digits the surrogate of an attempt is longer than its format."""
    return f"least(greatest(cast({attempt} as int) - {WIDEN - 1}, 0), {WIDEST})"


def _syllables(seed: str, script: str, more: str) -> str:
    """Three syllables and up to five more, the first letter a capital."""
    h = lambda i: f"cast(conv(substr({seed}, {i}, 2), 16, 10) as int)"
    out = []
    for name, (consonants, vowels, *_) in SYLLABLES.items():
        parts = [f"substr({_q(s)}, {h(8 * k + j)} % {len(s)} + 1, 1)" for k in range(8) for j, s in ((1, consonants), (4, vowels))]
        longer = f"if({more} = 0, '', substr(concat({', '.join(parts[6:])}), 1, 2 * {more}))"
        out.append(f"WHEN '{name}' THEN concat(upper({parts[0]}), {', '.join(parts[1:6])}, {longer})")
    return f"CASE {script} {' '.join(out)} END"


def _composed(type_: str, form: str, seed: str, more: str) -> str:
    """A word of syllables with the ending that its form has."""
    script, last = f"substr({type_}, 6)", f"substr({form}, -1)"
    cases = " ".join(f"WHEN '{name}' THEN if(contains('{women}', {last}), concat(substr(y, 1, length(y) - 1), '{women[0]}'), concat(y, '{closing}'))" for name, (_, _, women, closing) in SYLLABLES.items())
    return f"transform(array({_syllables(seed, script, more)}), y -> CASE {script} {cases} END)[0]"


def listed(type_: str, form: str) -> str:
    """SQL: whether a word is a given name of the lists."""
    return "(" + " OR ".join(f"{type_} = 'name-{script}' AND {form} IN ({', '.join(map(_q, names))})" for (_, script), names in GIVEN.items()) + ")"


def surrogate(type_: str, form: str, attempt: str, key: str) -> str:
    """SQL for the surrogate of an entity's form under a key."""
    key_ = _q(key)
    tag = (key_, type_, attempt)
    seed, more = _hash(*tag, form), _wider(attempt)
    longer = lambda x, c: f"concat({x}, repeat('{c}', {more}))"
    local = longer(f"substring_index({form}, '@', 1)", "a")
    mail = f"concat({_pattern(local, seed)}, '@', {_domain(form, key_)})"
    middle = longer(f"substr({form}, 2, length({form}) - 2)", "0")
    body = f"concat(substr({form}, 1, 1), {_feistel(middle, *tag)})"
    check = f"cast((10 - {_luhn_sum('concat(y, ' + chr(39) + '0' + chr(39) + ')')} % 10) % 10 as string)"
    card = f"transform(array({body}), y -> concat(y, {check}))[0]"
    account = f"transform(array({_pattern(longer(f'substr({form}, 5)', '0'), seed)}), y -> concat(substr({form}, 1, 2), lpad(cast(98 - {_mod97(f'concat(y, substr({form}, 1, 2), {chr(39)}00{chr(39)})')} as string), 2, '0'), y))[0]"
    phone = f"concat(split_part({form}, '.', 1), '.', {_feistel(longer(f'split_part({form}, {chr(39)}.{chr(39)}, 2)', '0'), *tag)})"
    walked = f"aggregate(sequence(1, {WALK}), {_feistel(longer(form, '0'), *tag)}, (y, i) -> if({_luhn_sum('y')} % 10 = 0, {_feistel('y', *tag)}, y))"
    cases = [
        f"WHEN {type_} = 'email' THEN {mail}", f"WHEN {type_} = 'iban' THEN {account}", f"WHEN {type_} = 'card' THEN {card}", f"WHEN {type_} = 'account' THEN {walked}",
        f"WHEN {type_} = 'ssn' THEN {_feistel(longer(form, '0'), *tag)}", f"WHEN {type_} = 'phone' THEN {phone}", f"WHEN {type_} = 'ipv4' THEN {_octets(form, *tag)}",
    ]
    cases.append(f"WHEN {type_} = 'particle' THEN {form} WHEN {type_} = 'initial' THEN {_initials(form, key)}")
    for (gender, script), names in GIVEN.items():
        all_, n = f"array({', '.join(map(_q, names))})", len(names)
        shift = f"cast({_number(key_, _q(gender), _q(script))} % {n - 1} as int)"
        cases.append(f"WHEN {type_} = 'name-{script}' AND {more} = 0 AND array_contains({all_}, {form}) THEN element_at({all_}, cast((array_position({all_}, {form}) + {shift}) % {n} + 1 as int))")
    return f"CASE {' '.join(cases)} ELSE {_composed(type_, form, seed, more)} END"


def _initials(form: str, key: str) -> str:
    """Each letter moved on in its alphabet, by as much as the key says."""
    moved = []
    for letters in ALPHABETS:
        shift = 1 + int(hashlib.sha256(f"{key}|{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
        moved.append(letters[shift:] + letters[:shift])
    return f"translate(regexp_replace({form}, '[^.{''.join(ALPHABETS)}]', 'X'), {_q(''.join(ALPHABETS))}, {_q(''.join(moved))})"


def _domain(form: str, key_: str) -> str:
    name = f"substring_index({form}, '@', -1)"
    return f"concat({_pattern(f'substr({name}, 1, length({name}) - length(substring_index({name}, {chr(39)}.{chr(39)}, -1)) - 1)', _hash(key_, _q('domain'), name))}, '.', substring_index({name}, '.', -1))"


def _placed(m: str, s: str) -> str:
    """The letters and digits of s at the places that letters and digits have in m, and after them what s has more."""
    step = f"if(rlike(c, '[0-9A-Za-z]'), named_struct('o', concat(t.o, substr({s}, t.i, 1)), 'i', t.i + 1), named_struct('o', concat(t.o, c), 'i', t.i))"
    return f"aggregate(transform(sequence(1, length({m})), i -> substr({m}, i, 1)), named_struct('o', '', 'i', 1), (t, c) -> {step}, t -> concat(t.o, substr({s}, t.i)))"


def _cased(m: str, s: str) -> str:
    """s with the capitals of m."""
    return f"concat(array_join(transform(sequence(1, length({m})), i -> if(substr({m}, i, 1) <> lower(substr({m}, i, 1)), upper(substr({s}, i, 1)), substr({s}, i, 1))), ''), substr({s}, length({m}) + 1))"


def _replaced(m: str, attempts: str | None, key: str) -> str:
    """SQL for what stands in place of a match m."""
    attempt = f"cast(coalesce(element_at({attempts}, concat(e.type, '|', e.form)), 0) as string)" if attempts else "'0'"
    found = f"transform({entities(m, 'k')}, e -> {surrogate('e.type', 'e.form', attempt, key)})"
    marks = f"regexp_extract_all({_rest(m)}, '[ -]', 0)"
    written = f"zip_with(s, {_names(m)}, (y, w) -> if({_is_particle('w')} OR {_is_initial('w')}, y, {_as_written('w', 'y')}))"
    name = f"concat(substr({m}, 1, locate(' ', {m})), array_join(zip_with({written}, {marks}, (w, c) -> concat(w, coalesce(c, ''))), ''))"
    halves = [_cased(f"substring_index({m}, '@', {i})", f"substring_index(s[0], '@', {i})") for i in (1, -1)]
    one = f"CASE WHEN k IS NULL THEN {m} WHEN k = 'person' THEN {name} WHEN k = 'email' THEN concat({halves[0]}, '@', {halves[1]}) WHEN k = 'ipv4' THEN s[0] ELSE {_placed(m, "replace(s[0], '.', '')")} END"
    return f"transform(transform(array({kind(m)}), k -> named_struct('k', k, 's', {found})), x -> transform(array(x.k), k -> transform(array(x.s), s -> {one})[0])[0])[0]"


def _matches(text: Column) -> Column:
    """All matches in text. The expression is slow; a text without a digit, an at sign and an honorific can't match any of its parts."""
    titles = [t for ts in HONORIFICS.values() for t in ts]
    maybe = F.coalesce(text, F.lit("")).rlike("[0-9@]")
    for t in titles:
        if not any(t != u and t.startswith(u) for u in titles):
            maybe = maybe | F.contains(F.coalesce(text, F.lit("")), F.lit(t))
    return F.when(maybe, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def corpus_entities(docs: DataFrame) -> DataFrame:
    """type, form: the distinct entities of all documents."""
    m = docs.select(F.explode(_matches(F.col("text"))).alias("m")).distinct()
    k = m.select("m", F.expr(kind("m")).alias("k")).where("k is not null")
    return k.select(F.explode(F.expr(entities("m", "k"))).alias("e")).select("e.type", "e.form").where("type NOT IN ('particle', 'initial')").distinct()


def collisions(found: DataFrame, key: str) -> DataFrame:
    """type, form, attempt of the entities that need another variant of the key than the first, over a settled table of entities."""
    named = lambda df: df.withColumn("surrogate", F.expr(surrogate("type", "form", "cast(attempt as string)", key)))
    state = settle(named(found.withColumn("attempt", F.lit(0))), "entities")
    real = found.select("type", F.col("form").alias("surrogate"), F.lit(True).alias("real"))
    rotates = f"{listed('type', 'form')} AND attempt < {WIDEN}"
    for _ in range(ATTEMPTS):
        order = F.struct(F.expr(f"NOT ({rotates})").alias("free"), "attempt", "form")
        first = settle(state.groupBy("type", "surrogate").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
        twice = state.join(first, ["type", "surrogate"]).where("form <> first.form").select("type", "form")
        # listed names rotate among themselves, so that a surrogate is a real name as a rule
        taken = state.join(real, ["type", "surrogate"], "left_semi").where(f"NOT ({rotates})").select("type", "form")
        bad = settle(twice.union(taken).distinct(), "collisions")
        discard(first)
        if bad.isEmpty():
            discard(bad)
            return state.where("attempt > 0").select("type", "form", "attempt")
        again = state.join(bad.withColumn("again", F.lit(1)), ["type", "form"], "left")
        new = settle(named(again.select("type", "form", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))), "entities")
        discard(state)
        state = new
    left = ", ".join(f"{r['count']} of {r['type']}" for r in bad.groupBy("type").count().collect())
    raise RuntimeError(f"after {ATTEMPTS} keys there are entities without a surrogate of their own: {left}")


def session_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING; where it is unset, a random one for this session, which it keeps."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def replace_pii(docs: DataFrame, key: str, *, with_entities: bool = False) -> DataFrame:
    """docs with surrogates under a key in text and, if asked for, entities (the kinds found, in order of appearance)."""
    if not key:
        raise ValueError("surrogates need a key")
    found = settle(corpus_entities(docs), "entities")
    special = settle(collisions(found, key), "attempts")
    n = special.count()
    keep = [c for c in docs.columns if not (with_entities and c == "entities")]
    rows = docs.select(F.struct(*columns(keep)).alias("_row"), F.col("text").alias("_text"))
    attempts = None
    if 0 < n <= LITERAL_LIMIT:
        pairs = [x for r in special.collect() for x in (F.lit(f"{r['type']}|{r['form']}"), F.lit(r["attempt"]))]
        rows, attempts = rows.withColumn("_attempts", F.create_map(*pairs)), "_attempts"
    elif n:
        rows, attempts = _joined(rows, special), "_attempts"
    m = rows.withColumn("_m", _matches(F.col("_text")))
    # no other match is without digits and an at sign
    words = f"filter(flatten(transform(filter(_m, m -> NOT rlike(m, '[0-9@]')), m -> {_names('m')})), w -> NOT ({_is_particle('w')} OR {_is_initial('w')}))"
    m = m.withColumn("_words", F.expr(f"array_distinct(flatten(transform({words}, w -> array(w, {_canonical('w')}, upper(w)))))"))
    wider = F.concat(F.lit(f"{PATTERN}|(?<![\\p{{L}}])(?:"), F.array_join("_words", "|"), F.lit(")(?![\\p{L}])"))
    m = m.withColumn("_m", F.when(F.size("_words") > 0, F.regexp_extract_all("_text", wider, F.lit(0))).otherwise(F.col("_m")))
    parts = F.when(F.size("_words") > 0, F.split(F.col("_text"), wider, -1)).otherwise(F.split(F.col("_text"), PATTERN, -1))
    new = F.expr(f"transform(_m, m -> {_replaced('m', attempts, key)})")
    joined = F.array_join(F.concat(F.array(F.element_at(parts, 1)), F.flatten(F.zip_with(new, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda a, b: F.array(a, b)))), "")
    text = F.when(F.size("_m") > 0, joined).otherwise(F.col("_text"))
    out = m.withColumn("_new", text)
    new_columns = [F.col("_new").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in keep]
    if with_entities:
        new_columns.append(F.expr(f"filter(transform(_m, m -> {kind('m')}), k -> k is not null)").alias("entities"))
    return out.select(*new_columns)


def _joined(rows: DataFrame, special: DataFrame) -> DataFrame:
    """rows with _attempts, a map for texts that hold an entity with a key of its own, else null."""
    digest = F.sha2("_text", 256)
    texts = rows.select(digest.alias("_digest"), F.explode(_matches(F.col("_text"))).alias("m")).distinct()
    keyed = texts.select("_digest", "m", F.expr(kind("m")).alias("k")).where("k is not null").select("_digest", F.explode(F.expr(entities("m", "k"))).alias("e")).select("_digest", "e.type", "e.form").distinct()
    maps = keyed.join(special, ["type", "form"]).groupBy("_digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "type", "form"), F.col("attempt")))).alias("_attempts"))
    return rows.withColumn("_digest", digest).join(settle(maps, "attempts"), "_digest", "left").drop("_digest")


def op5_pii_surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    done = replace_pii(docs.select("doc_id", "text"), key or session_key(docs.sparkSession), with_entities=True)
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *[F.size(F.expr(f"filter(entities, x -> x = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS])
