"""Tokens of a text, and rule labels for the bounded training sample of the random field.

The rules mark values in the sample only; every text is labelled by the field, which sees tokens and never these patterns. Given names
and the endings of family names are learned from the sample itself (`learn_names`): from what stands behind titles, salutations and closings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

#: The kinds in this order; a label is 0 for none, 2k - 1 for the first token of kind k and 2k for the others.
KINDS = ("none", "email", "phone", "identity_number", "street_address", "person_name")

#: Street words and particles by language.
STREET_EN = "Street|Road|Lane|Avenue|Drive|Court|Close|Way|Place|Square|Terrace|Ave\\.?|Rd\\.?|Ln\\.?|Dr\\.|Ct\\.?|Blvd\\.?|St\\.?"
STREET_FR = "rue|avenue|boulevard|allée|place|chemin|quai|impasse|route|av\\.|bd\\.?"
STREET_ES = "Calle|C/|Plaza|Avenida|Avda\\.?|Paseo|Camino|Ronda"
STREET_DE = "straße|strasse|str\\.|allee|weg|gasse|platz|ufer|ring|damm"
PARTICLES = "van der|van den|van|von|de la|del|de|da|di"
#: Words after which a name is certain enough to learn from, by language.
BEFORE_NAMES = (
    r"\b(?:Dr|Prof|Mr|Mrs|Ms|Mme|Mlle|Sr|Sra|Dra)\.? ", r"\b(?:Frau|Herr|Don|Doña|Patient(?:e|in)?) ", r"\b(?:Regards|Best|Sincerely|Thanks|Cordialement|Saludos|Grüßen|Gruß),?\n", r"\b(?:Contact|Contacto|Kontakt) ?: ", r"\b(?:Thanks to|Signed off:|cc:|written by|signed by|taken by|checked by) ?",
)

#: Titles, salutations, articles and words of street names, which stand before names and are none.
TITLES = frozenset("dr prof mr mrs ms mme mlle sr sra dra frau herr don doña patient patiente patientin la el die der das the le les hi hello hallo hola bonjour dear am im calle plaza avenida paseo ronda rue north south east west old new upper lower".split())

_CAP = r"[A-ZÄÖÜÉ][\wäöüßé'’-]+"
_EMAIL = (
    r"(?<![\w.+-])[\w][\w.+-]*(?:\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[\w-]+)*|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)"
)
_ADDRESS = "|".join((
    rf"(?<![\w.,-])\d{{1,4}}(?:[ -]?[A-Za-z](?![\w]))?(?:[-–/]\d{{1,4}})?,? (?:{_CAP} ){{1,3}}(?i:{STREET_EN})(?!\w)",
    rf"(?<![\w.,-])\d{{1,4}}(?: ?(?:(?i:bis|ter)|[A-Za-z](?!\w)))?,? (?i:{STREET_FR}) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?{_CAP}",
    rf"(?<!\w)(?:{_CAP} )?(?i:[a-zäöüß]+(?:{STREET_DE})),? \d{{1,4}}(?: ?[A-Za-z](?!\w))?(?:[-–/]\d{{1,4}}(?: ?[A-Za-z](?!\w))?)?(?!\w)",
    rf"(?<!\w)(?:Am|Im|An der|Auf dem|Zum|Zur|AM|IM) {_CAP} \d{{1,4}}(?: ?[a-z](?!\w))?(?:[-–/]\d{{1,4}})?(?!\w)",
    rf"(?<!\w)(?i:{STREET_ES}) (?:(?i:de la|del|de los|de) )?{_CAP}(?: {_CAP})?,? (?:n\.?\s?º ?|N\.?\s?º ?|num\. ?|nº ?)?\d{{1,4}}(?: ?[a-z](?!\w))?(?!\w)",
))
_IDENTITY = r"(?<![\w.+-])(?:\d{3}(?P<sep>[-. ])\d{2}(?P=sep)\d{4}|\d{4}-\d{4}-\d|[A-Z]{2}\d{7}|\d{6}[-+A]\d{3}[A-Z0-9]|(?i:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]))(?![\w-])"
_PHONE = (
    r"(?<![\w.+/-])(?:(?:(?:\+|00)1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}|1\d{10}"
    r"|(?:(?:\+|00)33[ .-]?(?:\(0\))?|0)\d(?:[ .]?\d{2}){4}"
    r"|(?:(?:\+|00)49[ -]?(?:\(0\) ?)?|0)\d{2,4}[ /-]\d{5}[ -]?\d{3}"
    r"|(?:(?:\+|00)44[ -]?(?:\(0\) ?)?|0)\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}|\(0\d{2,4}\) ?\d{3,4}[ -]\d{3,4}|0\d{3} \d{6}"
    r"|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,5})(?![\w])"
)
_NUMBER = r"(?<![\w])[\w.:/@+-]*\d[\w.:/@+-]*\w"
_VALUES = re.compile(rf"(?P<email>{_EMAIL})|(?P<address>{_ADDRESS})|(?P<phone>{_PHONE})|(?P<identity>{_IDENTITY})|(?P<number>{_NUMBER})")
_MAIL_END = re.compile(r"(?:\.|\[dot\] ?|\(dot\) ?| dot )[A-Za-z]{2,}$")
_INITIALS = r"[A-Za-z]\.(?:[ -]?[A-Za-z]\.)*"
_LETTERS = r"[^\W\d_]"

TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]|_")


@dataclass
class Names:
    """Given names, endings of family names, and the pattern of a full name made of them and of known family names."""

    given: frozenset[str]
    endings: frozenset[str]
    pattern: re.Pattern | None


def _pattern(given: Iterable[str], endings: Iterable[str], family: Iterable[str]) -> re.Pattern | None:
    given, endings, family = sorted(given), sorted(endings, key=len, reverse=True), sorted(family, key=len, reverse=True)
    if not given or not (endings or family):
        return None
    g = f"(?:{'|'.join(map(re.escape, given))})"
    shared = [rf"{_LETTERS}{{2,}}(?:{'|'.join(map(re.escape, endings))})"] if endings else []
    f = f"(?:{'|'.join([*shared, *map(re.escape, family)])})"
    first, family = rf"(?:{g}(?:-{g})?(?: {_INITIALS})?|{_INITIALS})", rf"(?:al-)?{f}(?:-{f})?"
    return re.compile(rf"(?<![\w@.+-])(?:{first}(?: (?:{PARTICLES}))? {family}|{family}, {first})(?![\w@-])", re.I)


def learn_names(texts: list[str], least: int = 2) -> Names:
    """Given names and family endings of the sample.

    Seeds stand behind titles, salutations and closings. A first word that is seen before `least` different family names is a given name;
    the words behind several given names that the texts do not use as plain words are family names; endings of four letters or fewer
    that several family names share, and that plain words hardly have, are family endings.
    """
    cap = rf"[A-ZÀ-Þ]{_LETTERS}+"
    seed = re.compile(rf"(?:{'|'.join(BEFORE_NAMES)})(?:(?:Dr|Prof)\.? )*(?P<a>{cap})(?:-{cap})?(?: [A-Z]\.)*(?: (?:{PARTICLES}))?(?: (?P<b>{cap})|, (?P<c>{cap}))")
    lower = Counter(w for t in texts for w in set(re.findall(rf"(?<![\w@.+-])[a-zà-ÿ]{_LETTERS}+(?![\w@+-]|\.\w| ?[\[(@])", t)))
    upper = Counter(w.lower() for t in texts for w in set(re.findall(rf"(?<![\w@.+-])[A-ZÀ-Þ]{_LETTERS}+(?![\w@-])", t)))
    plain = {w for w, n in lower.items() if n >= 4 and n >= upper[w]}
    after: dict[str, set[str]] = {}
    for t in texts:
        for m in seed.finditer(t):
            first, last = (m["a"], m["b"]) if m["b"] else (m["c"], m["a"])
            if first.lower() not in plain and last.lower() not in plain:
                after.setdefault(first.lower(), set()).add(last.lower())
    given = {g for g, f in after.items() if len(f) >= least} - TITLES
    pair = re.compile(rf"(?<![\w@.+-])({cap})(?:-{cap})?(?: [A-Z]\.)*(?: (?:{PARTICLES}))? ({cap})(?![\w@-])|(?<![\w@.+-])(?P<l>{cap}), (?P<f>{cap})(?![\w@-])")
    pairs = Counter()
    for t in texts:
        for m in pair.finditer(t):
            a, b = ((m[1], m[2]) if m[1] else (m["f"], m["l"]))
            if a.lower() not in plain and b.lower() not in plain:
                pairs[a.lower(), b.lower()] += 1
    common: Counter[str] = Counter(w[-k:] for w in plain for k in (3, 4, 5) if len(w) > k + 1)
    good: set[str] = set()
    for _ in range(4):
        family = {b for a, b in pairs if a in given} - given
        ends: Counter[str] = Counter(f[-k:] for f in family for k in (3, 4, 5) if len(f) > k + 1)
        good = {e for e, n in ends.items() if n >= max(least, len(family) // 150) and n >= 8 * common[e]}
        # first words that stand before several words with such an ending are given names too
        more: dict[str, set[str]] = {}
        for a, b in pairs:
            if b.endswith(tuple(good)) and not a.endswith(tuple(good)):
                more.setdefault(a, set()).add(b)
        given |= {a for a, f in more.items() if len(f) >= least} - TITLES
    beside: dict[str, set[str]] = {}
    for a, b in pairs:
        if a in given and b not in given:
            beside.setdefault(b, set()).add(a)
    known = {b for b, g in beside.items() if len(g) >= least and not b.endswith(tuple(good))}
    return Names(frozenset(given), frozenset(good), _pattern(given, good, known))


def rule_spans(text: str, names: Names) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by rules, without overlaps; for the sample only."""
    out: list[tuple[int, int, int]] = []
    kinds = {"email": 1, "phone": 2, "identity": 3, "address": 4}
    taken = []
    for m in _VALUES.finditer(text):
        kind = next(k for k in ("email", "address", "phone", "identity", "number") if m.group(k) is not None)
        taken.append((m.start(), m.end()))
        if kind == "email" and not _MAIL_END.search(m.group()):
            continue
        if kind in kinds:
            out.append((m.start(), m.end(), kinds[kind]))
    if names.pattern is not None:
        p = 0
        for m in names.pattern.finditer(text):
            while p < len(taken) and taken[p][1] <= m.start():
                p += 1
            if p == len(taken) or taken[p][0] >= m.end():
                out.append((m.start(), m.end(), 5))
    return sorted(out)


def token_labels(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """A label for each token (start, end)."""
    out, p = [0] * len(tokens), 0
    for a, b, k in spans:
        while p < len(tokens) and tokens[p][0] < a:
            p += 1
        first = True
        while p < len(tokens) and tokens[p][1] <= b:
            out[p] = 2 * k - 1 if first else 2 * k
            first = False
            p += 1
    return out
