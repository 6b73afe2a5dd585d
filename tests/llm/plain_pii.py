"""The surrogates in plain Python, for tests: the whole corpus in memory, one text after another."""

import hashlib

import regex

from folioscope.llm import pii

KEY = "a key of the tests"


def digest(*parts):
    return hashlib.sha256("|".join([KEY, *parts]).encode()).hexdigest()


def number(*parts):
    return int(digest(*parts)[:15], 16)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x) or "0") % 97


def digits(m):
    return regex.sub("[^0-9]", "", m)


def kind(m):
    d, bare = digits(m), m.replace(" ", "")
    if "@" in m:
        return "email"
    if regex.match("[A-Z]{2}[0-9]{2}", m):
        return "iban" if mod97(bare[4:] + bare[:4]) == 1 else None
    if regex.fullmatch(rf"{pii._OCTET}([.]{pii._OCTET}){{3}}", m):
        return "ipv4"
    if regex.fullmatch("[0-9][0-9 -]*", m) and len(d) >= 13:
        return "account" if luhn(d) % 10 else "card"
    if regex.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        return "ssn"
    return "phone" if m[0] in "+(0123456789" else "person"


def words(m):
    return regex.split("[ -]", m[m.find(" ") + 1 :])


def script(w):
    return next((s for s in pii.SYLLABLES if s != "latin" and regex.match(rf"\p{{{s}}}", w)), "latin")


def is_initial(w):
    return len(w) == 1 or "." in w


def canonical(w):
    return (w[:1] + w[1:].lower()).replace("’", "'")


def initials(w):
    out = ""
    for c in w:
        letters = next((a for a in pii.ALPHABETS if c in a), None if c == "." else pii.ALPHABETS[0])
        if letters:
            shift = 1 + int(hashlib.sha256(f"{KEY}|{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
            c = letters[((letters.index(c) if c in letters else letters.index("X")) + shift) % len(letters)]
        out += c
    return out


def as_written(w, s):
    out, at = "", 0
    for c in w:
        if c in "'’":
            out += c
        else:
            out, at = out + (s[at : at + 1].upper() if c != c.lower() else s[at : at + 1]), at + 1
    out += s[at:]
    return out.upper() if len(w) > 1 and w == w.upper() else out


def entities(m):
    k, d = kind(m), digits(m)
    if k == "phone":
        apart = regex.match("[+]([0-9]{1,3})(?=[^0-9])", m)
        code = "" if m[0] != "+" else apart[1] if apart else regex.match(pii.COUNTRY, m[1:])[1]
        return [("phone", f"{code}.{d[len(code) :]}")]
    if k == "person":
        return [(f"name-{script(w)}", canonical(w)) for w in words(m) if w not in pii.PARTICLES and not is_initial(w)]
    return [] if k is None else [(k, {"email": m.lower(), "iban": m.replace(" ", ""), "ipv4": m}.get(k, d))]


def feistel(d, *tag):
    n, u = len(d), len(d) // 2
    if n < 2:
        return d
    a, b = int(d[:u]), int(d[u:])
    for r in (1, 2, 3, 4):
        if r % 2:
            a = (a + number(*tag, str(r), str(n), str(b))) % 10**u
        else:
            b = (b + number(*tag, str(r), str(n), str(a))) % 10 ** (n - u)
    return f"{a:0{u}}{b:0{n - u}}"


def octets(form, *tag):
    o = [int(x) for x in form.split(".")]
    a, b = o[0] * 256 + o[1], o[2] * 256 + o[3]
    for r in (1, 2, 3, 4):
        if r % 2:
            a = (a + number(*tag, str(r), str(b))) % 65536
        else:
            b = (b + number(*tag, str(r), str(a))) % 65536
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def pattern(text, seed):
    out = ""
    for i, c in enumerate(text, 1):
        h = int(seed[2 * (i % 31) : 2 * (i % 31) + 3], 16)
        out += chr(48 + h % 10) if "0" <= c <= "9" else chr(97 + h % 26) if "a" <= c <= "z" else chr(65 + h % 26) if "A" <= c <= "Z" else c
    return out


def is_listed(kind_, form):
    return any(kind_ == f"name-{s}" and form in names for (_, s), names in pii.GIVEN.items())


def surrogate(kind_, form, attempt):
    tag, more = (kind_, str(attempt)), min(max(attempt - pii.WIDEN + 1, 0), pii.WIDEST)
    seed = digest(*tag, form)
    if kind_ == "email":
        local, host = form.split("@")
        name, top = host.rsplit(".", 1)
        return f"{pattern(local + 'a' * more, seed)}@{pattern(name, digest('domain', host))}.{top}"
    if kind_ == "iban":
        y = pattern(form[4:] + "0" * more, seed)
        return f"{form[:2]}{98 - mod97(y + form[:2] + '00'):02}{y}"
    if kind_ == "card":
        y = form[0] + feistel(form[1:-1] + "0" * more, *tag)
        return f"{y}{(10 - luhn(y + '0') % 10) % 10}"
    if kind_ == "account":
        y = feistel(form + "0" * more, *tag)
        while luhn(y) % 10 == 0:
            y = feistel(y, *tag)
        return y
    if kind_ == "ssn":
        return feistel(form + "0" * more, *tag)
    if kind_ == "phone":
        code, rest = form.split(".")
        return f"{code}.{feistel(rest + '0' * more, *tag)}"
    if kind_ == "ipv4":
        return octets(form, *tag)
    for (gender, s), names in pii.GIVEN.items():
        if kind_ == f"name-{s}" and form in names and not more:
            return names[(names.index(form) + 1 + number(gender, s) % (len(names) - 1)) % len(names)]
    consonants, vowels, women, closing = pii.SYLLABLES[kind_[5:]]
    out = "".join(x[int(seed[8 * k + j : 8 * k + j + 2], 16) % len(x)] for k in range(3 + more) for j, x in ((0, consonants), (3, vowels)))
    out = out[0].upper() + out[1:]
    return out[:-1] + women[0] if form[-1] in women else out + closing


def placed(m, s):
    out, at = "", 0
    for c in m:
        if regex.match("[0-9A-Za-z]", c):
            out, at = out + s[at : at + 1], at + 1
        else:
            out += c
    return out + s[at:]


def cased(m, s):
    return "".join(y.upper() if x != x.lower() else y for x, y in zip(m, s, strict=False)) + s[len(m) :]


def replaced(m, named):
    k = kind(m)
    if k is None:
        return m
    if k == "person":
        marks = regex.findall("[ -]", m[m.find(" ") + 1 :])
        s = [w if w in pii.PARTICLES else initials(w) if is_initial(w) else as_written(w, named[f"name-{script(w)}", canonical(w)]) for w in words(m)]
        return m[: m.find(" ") + 1] + "".join(a + b for a, b in zip(s, [*marks, ""], strict=True))
    s = [named[e] for e in entities(m)]
    if k == "email":
        return "@".join(cased(x, y) for x, y in zip(m.split("@"), s[0].split("@"), strict=True))
    return s[0] if k == "ipv4" else placed(m, s[0].replace(".", ""))


def names_for(found):
    """entity -> surrogate, all distinct and none that occurs."""
    attempt = dict.fromkeys(found, 0)
    while True:
        named = {e: surrogate(*e, n) for e, n in attempt.items()}
        free = {e: not (is_listed(*e) and attempt[e] < pii.WIDEN) for e in found}
        first = {}
        for e in sorted(found, key=lambda e: (free[e], attempt[e], e[1])):
            first.setdefault((e[0], named[e]), e)
        bad = [e for e in found if first[e[0], named[e]] != e or free[e] and (e[0], named[e]) in found]
        if not bad:
            return named
        for e in bad:
            attempt[e] += 1


def replace(docs):
    """(doc_id, text, kinds) of each document."""
    plain = regex.compile(pii.PATTERN)
    found = {e for _, t in docs for m in plain.finditer(t or "") for e in entities(m[0])}
    named, out = names_for(found), []
    for doc_id, text in docs:
        mine = {w for m in plain.finditer(text or "") if kind(m[0]) == "person" for w in words(m[0])}
        mine = {x for w in mine if w not in pii.PARTICLES and not is_initial(w) for x in (w, canonical(w), w.upper())}
        bare = rf"|(?<![\p{{L}}])(?:{'|'.join(sorted(mine))})(?![\p{{L}}])" if mine else ""
        whole, kinds = regex.compile(pii.PATTERN + bare), []
        for m in whole.finditer(text or ""):
            kinds += [kind(m[0])] if kind(m[0]) else []
        out.append((doc_id, text and whole.sub(lambda m: replaced(m[0], named), text), kinds))
    return out
