"""Personal items in text: found, replaced by typed placeholders or by surrogates.

Found are email addresses (also disguised), phone numbers, identity numbers, street
addresses and names. All but names have forms of their own. Names are looked up in a
lexicon of given and family names that the corpus itself supplies: the display names of
all its mail addresses, with a table of given names beside. Given names that are plain
words too count where a family name, a mark or the words around them say so.

A replacement is keyed: the same item gets the same one everywhere (names by their words,
so that parts of a name stay parts of one), different items different ones. Surrogates
keep the form of the item: digits for digits, letters of the same script and case, the
signs and the disguise of a mail address, whose domain comes under a reserved one. Given
names get one of the same gender where the name's is known, else one that is anybody's. Keyed
hashes can meet; `collisions` finds all such items of the corpus, for names their words, and
salts for all but one of them with which none meet, in rounds that check the new surrogates
too. Placeholders have codes of 80 bits, which do not meet in practice and are not checked.

Defined cases: null and empty texts have no item and stay as they are; a text is read
whole; overlapping finds count for the first of email, identity number, phone, address,
name; repeated rows are treated each; other columns pass unchanged.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut, ship

#: Names that may be broadcast; with more, each row is joined with the names it holds.
MAX_NAMES = 500_000

_S = "[ \t\xa0     　]"
_U = "А-ЯЁЄІЇҐΑ-ΩΆΈΉΊΌΎΏA-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_W = r"[^\W\d_]"

_DOMAIN = re.compile(r"@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}")
_LOCAL = re.compile(r"[\w+](?:[\w.+\-]*[\w+])?$")
_AT = rf"(?:{_S}?[\[(]{_S}?(?:at|AT|At|@){_S}?[\])]{_S}?|{_S}AT{_S})"
_DOT = rf"(?:\.|{_S}?[\[(]{_S}?(?:dot|DOT|Dot|punkt|punto|point){_S}?[\])]{_S}?|{_S}DOT{_S})"
_AT_MARK = re.compile(rf"{_S}?[\[(]{_S}?(?:at|AT|At|@){_S}?[\])]{_S}?|{_S}AT{_S}")
_AT_SIGNS = ("(at", "[at", "( at", "[ at", "AT", "(At", "[At", "(@", "[@", "( @", "[ @")
_HIDDEN_DOMAIN = re.compile(rf"[\w\-]+(?:{_DOT}[\w\-]+)+")
_FILES = ("png", "jpg", "jpeg", "gif", "svg", "webp", "pdf", "css", "js")

# Labels of identity numbers.
_LABEL = (
    r"(?:SSN|SIN|NIN|NINO|NIR|DNI|NIE|NIF|CPF|social security (?:number|no\.?)|soc\. ?sec\. ?(?:number|no\.?)|(?:NI|national insurance) (?:number|no\.?)"
    r"|passport(?: (?:number|no\.?))?|passeport(?: n°)?|pasaporte|Reisepass(?:-Nr\.?)?|tax (?:ID|number|no\.?)|TIN|Steuer-?ID(?:-?Nr\.?)?|Steuernummer"
    r"|national ID(?: (?:number|no\.?))?|ID card|Personalausweis(?:-Nr\.?)?|Ausweisnummer|(?:n°|numéro)(?: de)? s[ée]cu(?:rité sociale)?|número de la seguridad social|Sozialversicherungsnummer)"
)
_LABEL_END = re.compile(rf"(?<!\w){_LABEL}{_S}?(?:[:#\-–]|is|ist|est|es)?{_S}?$", re.I)
_VALUE = re.compile(r"(?:[A-Z]{1,3}[ \-]?)?\d(?:[ .\-/]?\d){4,16}(?:[ \-]?[A-Z])?(?!\w)")
_LETTERS = re.compile(r"(?<![A-Za-z])[A-Z]{1,3}[ \-]?$")
#: Digits with what may stand between those of one number.
_RUN = re.compile(r"[+(]*\d(?:[\d \xa0   .\-/()]*\d)?")
_ID_FORMS = re.compile(
    r"(?<![\w.\-/])(?:\d{3}([\-. ])\d{2}\1\d{4}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{8}-[A-Z]|[XYZ]-?\d{7}-[A-Z])(?![\w\-]|\.\d)"
)
_NO_ID = re.compile(r"(?:order|ticket|invoice|tracking|code|PO|ref\.?|reference|Bestellung|Rechnung|commande|facture|pedido|factura)\W{0,3}(?:no\.?|number|nr\.?)?\W{0,3}$", re.I)

_P = r"[ \xa0   .\-]"
_EXT = rf"(?:,?{_S}?(?:ext(?:\.|ension)?|x|poste|Durchwahl|App\.){_S}?\d{{1,5}}(?!\d))?"
_PHONE = re.compile(
    rf"(?<![\w+\-/])(?<!\d\.)(?:"
    rf"(?:\+\d{{1,3}}|00[1-9]\d{{0,2}}(?={_P})){_P}?(?:\(0\){_P}?)?(?:\(\d{{1,4}}\){_P}?)?\d(?:[ \xa0   .\-/]?\d){{5,13}}"
    rf"|(?:1{_P})?(?:\(\d{{3}}\){_S}?|\d{{3}}{_P})\d{{3}}{_P}\d{{4}}"
    rf"|(?:\(0\d{{2,4}}\){_S}?|0\d{{2,4}}{_P})\d{{3,4}}{_P}\d{{3,4}}"
    rf"|0[1-9](?:{_P}\d{{2}}){{4}}"
    rf"|(?:\(0\d{{2,4}}\){_S}?|0\d{{2,4}}[ \xa0/\-])\d{{4,8}}(?:[ \-]\d{{1,4}})?"
    rf")(?![\d\-/]|\.\d){_EXT}"
)
_DAY = re.compile(r"\d{2,4}[.\-/]\d{1,2}[.\-/]\d{2,4}$")

_UNIT = rf"(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|Floor|Fl\.){_S}#?\w{{1,5}}"
_AFTER = rf"(?:,?{_S}{_UNIT}(?!\w)|,?{_S}#{_S}?\w{{1,5}}|,{_S}\d{{1,2}}(?:st|nd|rd|th){_S}[Ff]loor)?"
# Words for streets in five languages.
_EN_STREET = "Street|Avenue|Road|Lane|Drive|Court|Close|Boulevard|Way|Place|Square|Terrace|Crescent|Row|Walk|Hill|Gardens|Parkway|Highway|St|Ave|Rd|Ln|Dr|Ct|Cl|Blvd|Pl|Sq|Ter|Cres|Pkwy|Hwy"
_DE_STREET = "straße|strasse|str\\.|weg|allee|platz|gasse|ring|damm|ufer|steig|chaussee|markt|hof|graben|zeile|pfad"
_FR_STREET = "rue|avenue|av\\.|boulevard|bd|bd\\.|place|pl\\.|chemin|allée|impasse|quai|cours|route|square|passage"
_ES_STREET = "Calle|C/|Avenida|Avda\\.?|Av\\.|Plaza|Pza\\.?|Paseo|P\\.º|Camino|Ronda|Carrera|Travesía"
_WORDS = rf"[{_U}][\w’'\-]+(?:{_S}[{_U}][\w’'\-]+){{0,3}}"
_DOTTED = r"\.(?=[.,;:)]|{S}[#a-zà-ÿ\d]|{S}?\n?$)".replace("{S}", _S)
_BEFORE_UNIT = re.compile(rf"(?<!\w){_UNIT},{_S}$")
_EN = re.compile(rf"\d{{1,5}}[A-Za-z]?{_S}(?:[{_U}][\w’'\-]+{_S}){{1,3}}?(?:{_EN_STREET})(?!\w)(?:{_DOTTED})?{_AFTER}", re.M)
_FR = re.compile(
    rf"\d{{1,4}}(?:{_S}?(?:bis|ter|[A-D]))?,?{_S}(?:{_FR_STREET}){_S}(?:(?:de{_S}la|de{_S}l[’']|des|du|de|d[’']|l[’']|la|le|les){_S}?)?{_WORDS}"
    rf"(?:,{_S}(?:(?:apt|appt|bât|app)\.?{_S}\w{{1,4}}|\d{{1,2}}(?:er|e|ème){_S}étage))?"
)
_BOX = re.compile(rf"(?<!\w)(?:P\.?{_S}?O\.?{_S}Box|Post Office Box|Postfach|BP|B\.P\.|Apartado(?:{_S}de{_S}[Cc]orreos)?|Apdo\.?){_S}$")
_BOX_NUMBER = re.compile(rf"\d{{1,3}}(?:{_S}?\d{{1,3}})?(?!\d)")
_ES_BEFORE = re.compile(
    rf"(?<!\w)(?:{_ES_STREET}){_S}(?:(?:de{_S}las|de{_S}los|de{_S}la|del|de|las|los|la|el){_S})?{_WORDS}(?:,{_S}|{_S}(?:n\.?º{_S})?)$"
)
_ES_NUMBER = re.compile(
    rf"\d{{1,4}}[A-Za-z]?(?!\w)(?:,{_S}(?:\d{{1,2}}\.?[ºª°o](?:{_S}(?:[A-Z]|izq\.?|dcha\.?|izda\.?)(?!\w))?|bajo(?:{_S}[A-Z](?!\w))?|ático|entresuelo|principal|piso{_S}\d+))?"
)
_DE_BEFORE = re.compile(
    rf"(?<![\w\-])(?:[{_U}][a-zäöüß\-]+(?:{_DE_STREET})|[{_U}][\wäöüß\-]+{_S}(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer|Markt)"
    rf"|(?:Am|An{_S}der|Im|Zum|Zur|Auf{_S}dem){_S}[{_U}][\wäöüß\-]+){_S}$"
)
_DE_NUMBER = re.compile(rf"\d{{1,4}}{_S}?[a-h]?(?!\w)(?:,{_S}(?:\d{{1,2}}\.{_S}(?:OG|Stock|Etage)|EG|Whg\.?{_S}\w+))?")

# The parts of a found address: the name of its street, and the codes around it.
_BOX_WHOLE = re.compile(rf"({_BOX.pattern[:-1]})(.*)", re.S)
_UNIT_FIRST = re.compile(rf"{_UNIT},{_S}")
_STREET_FORMS = [
    re.compile(form, re.S)
    for form in (
        rf"\d{{1,5}}[A-Za-z]?{_S}(?P<name>(?:[{_U}][\w’'\-]+{_S}){{1,3}}?)(?:{_EN_STREET})(?!\w)\.?(?:{_AFTER})",
        rf"\d{{1,4}}(?:{_S}?(?:bis|ter|[A-D]))?,?{_S}(?:{_FR_STREET}){_S}(?:(?:de{_S}la|de{_S}l[’']|des|du|de|d[’']|l[’']|la|le|les){_S}?)?(?P<name>{_WORDS})(?:,.*)?",
        rf"(?:{_ES_STREET}){_S}(?:(?:de{_S}las|de{_S}los|de{_S}la|del|de|las|los|la|el){_S})?(?P<name>{_WORDS})(?:,{_S}|{_S}(?:n\.?º{_S})?)\d.*",
        rf"(?P<name>[{_U}][\wäöüß\-]+){_S}(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer|Markt){_S}\d.*",
        rf"(?:Am|An{_S}der|Im|Zum|Zur|Auf{_S}dem){_S}(?P<name>[{_U}][\w’'\-]+){_S}\d.*",
        rf"(?P<name>[{_U}][a-zäöüß\-]*?[a-zäöüß])-?(?:{_DE_STREET}){_S}\d.*",
    )
]
_NAME_WORD = re.compile(rf"[{_U}](?:[\w’'\-]*\w)?")
_CODES = re.compile(
    rf"((?<!\w)(?:Flat|Apt|Apartment|Unit|Suite|Ste|Room|Floor|Fl|apt|appt|bât|app|Whg)\.?{_S}#?|#{_S}?)\w+|\d+|(?<![\w.])[A-Z](?![\w.])"
    rf"|(?<=\d)(?:[A-Z]|[a-dfgh]|e(?!{_S}étage))(?!\w)|(?<=\d{_S})[a-h](?!\w)"
)

_CAPS = re.compile(rf"[{_U}][\w’'\-]*")
_INITIAL = re.compile(rf"(?<![\w.])([{_U}]\.)(?:{_S}?[{_U}]\.)?{_S}$")
_MIDDLE = re.compile(rf"{_S}[{_U}]\.(?:{_S}?[{_U}]\.)?(?={_S})")
_TITLE = re.compile(rf"(?:Cher|Chère|Bonjour|Monsieur|Estimado|Estimada){_S}M\.{_S}$")
# Given names that are also plain words, with the months.
PLAIN = frozenset(
    "April August June May Art Autumn Bill Chase Christian Crystal Daisy Dawn Drew Faith Frank Gene Grace Guy Harry Heather Hope Iris Ivy Jack Joy Jasmine"
    " Lance Lily Mark Max Miles Norm Olive Pat Pearl Penny Ray Rich Rob Robin Rose Ruby Rusty Sandy Skip Sky Stone Sue Summer Sunny Violet Ward Will".split()
)
# Words of firms.
_FIRM = re.compile(
    rf"{_S}(?:&{_S}(?:Sons|Co|Partners?|Söhne|Fils|Hijos|[{_U}])|(?:GmbH|Holdings?|AG|KG|Ltd|LLC|Inc|PLC|plc|SA|SARL|SL|Corp|Group|Studios?|Partners|Media|Labs|Logistics|Foundation|Industries|Bank|Avenue|Street|Road)(?!\w))"
)
_CUE = re.compile(
    rf"(?:^|[\s(>|*•\-])(?:hi|hey|hello|dear|good (?:morning|afternoon|evening)|hola|buenos días|estimad[oa]|querid[oa]|liebe[rs]?|hallo|guten (?:tag|morgen)|cher|chère|salut|bonjour|moin"
    rf"|cc|to|for|with|by|from|ask|asked|call|tell|and|or|von|an|mit|laut|bei|und|oder|selon|avec|de|à|et|ou|según|con|para|y|o|joindre|erreichen|llamar a|preguntar por|thanks|m[rs]s?\.?|dr\.?|prof\.?)[:,]?{_S}(?:{_W}+\.{_S})?$",
    re.I,
)
_GOES_ON = re.compile(
    rf"{_S}(?:will|has|had|who|or|and|on|at|for|about|from|schaut|unter|lautet|und|oder|passt|hat|oder|y|o|et|ou|lo|la|es|est|au|al|wrote|said|says|asked|raised|\(|<|{_W}+@)|{_S}?[,;:.!?)>]*{_S}*(?:$|[\r\n])|{_S}?[,!]?{_S}[\-–—]|{_S}?\||{_S}[(<]",
    re.M,
)
_DATE_BEFORE = re.compile(rf"(?:\d{{1,2}}\.?|until|till|since|in|of|during|early|late|mid|next|last|by|before|after){_S}$", re.I)
_DATE_AFTER = re.compile(rf"{_S}?\.?,?{_S}\d{{1,4}}(?!\d)")


@dataclass(frozen=True)
class Lexicon:
    """Given names, and family names by their last word, with the particles before it ('' for none)."""

    given: frozenset
    family: dict

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Lexicon:
        """From (kind, name), kind being g or f."""
        given, family = set(), {}
        for kind, name in rows:
            if kind == "g":
                given |= {name, name.upper()}
            else:
                particles, _, last = name.rpartition(" ")
                for p, w in ((particles, last), (particles.upper(), last.upper())):
                    family.setdefault(w, set()).add(p)
        return Lexicon(frozenset(given), {w: tuple(sorted(p, key=len, reverse=True)) for w, p in family.items()})


def _taken(start: int, end: int, spans: list) -> bool:
    return any(s < end and start < e for s, e, _ in spans)


def _capitals(text: str) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the words that may be names, without possessives and marks at their ends."""
    for m in _CAPS.finditer(text):
        word = m.group()
        start, end = m.span()
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@"):
            continue
        if word.endswith(("’s", "'s")):
            word, end = word[:-2], end - 2
        while word and word[-1] in "-'’":
            word, end = word[:-1], end - 1
        yield word, start, end


def _names(text: str, lexicon: Lexicon, spans: list) -> list[tuple[int, int, str]]:
    given, family = lexicon.given, lexicon.family
    parts = []  # (start, end, kind)
    for word, start, end in _capitals(text):
        kind = None
        if word in family:
            for particles in family[word]:
                if not particles:
                    kind = "f"
                    break
                if text.endswith(particles + " ", 0, start):
                    kind, start = "f", start - len(particles) - 1
                    break
        if word in given and (kind is None or (kind == "f" and word not in family)):
            kind = "g"
        elif kind is None and "-" in word and all(p in given for p in word.split("-")):
            kind = "g"
        if kind:
            parts.append((start, end, kind))
    out = []
    i = 0
    while i < len(parts):
        start, end, kind = parts[i]
        full = False
        i += 1
        if kind == "g":
            middle = _MIDDLE.match(text, end)
            at = middle.end() if middle else end
            if i < len(parts) and parts[i][2] == "f" and parts[i][0] - at == 1 and text[at] in " \xa0":
                end, full = parts[i][1], True
                i += 1
        else:
            if i < len(parts) and parts[i][2] == "g" and text[end : parts[i][0]] in (", ", ",\xa0"):
                comma_end = parts[i][1]
                follows_family = i + 1 < len(parts) and parts[i + 1][2] == "f" and parts[i + 1][0] - comma_end == 1
                if not follows_family:
                    end, full = comma_end, True
                    middle = re.compile(rf"{_S}[{_U}]\.(?!\w)").match(text, end)
                    if middle and re.match(rf"{_S}?(?:[<(\"]|{_S}[a-z])", text[middle.end() :]):
                        end = middle.end()
                    i += 1
            initial = _INITIAL.search(text, max(0, start - 8), start)
            if initial and not _TITLE.search(text, max(0, start - 14), start):
                start, full = initial.start(1), True
        if _taken(start, end, spans):
            continue
        if not full:
            if kind == "f" and _FIRM.match(text, end):
                continue
            if kind == "g" and not _stands(text, start, end):
                continue
        elif _FIRM.match(text, end) and text[end : end + 2] == " &":
            continue
        out.append((start, end, "name" if full or kind == "f" else "given"))
    return out


def _stands(text: str, start: int, end: int) -> bool:
    """Whether a given name alone is a person here."""
    word = text[start:end]
    if _FIRM.match(text, end):
        return False
    if word.title() not in PLAIN:
        return True
    if word.isupper() and len(word) > 1:
        line = text[text.rfind("\n", 0, start) + 1 : start]
        return bool(_CUE.search(line)) and not re.search(r"[A-Z]{3,} $", line)
    before = text[max(0, start - 30) : start]
    if word.title() in ("May", "April", "June", "August") and (_DATE_BEFORE.search(before) or _DATE_AFTER.match(text, end)):
        return bool(re.search(rf"(?:^|\n)[>| ]*(?:hi|hey|hello|dear|liebe[rs]?|hola|cher|chère|salut){_S}$", before, re.I))
    if _CUE.search(before):
        return not re.match(rf"{_S}(?:you|my|the|this|feedback|is|do)\b", text[end:])
    return bool(_GOES_ON.match(text, end)) and not re.match(rf"{_S}(?:is|my|you|do|this)\b", text[end:])


def _emails(text: str, spans: list) -> None:
    at = text.find("@")
    while at >= 0:
        domain, local = _DOMAIN.match(text, at), _LOCAL.search(text[max(0, at - 64) : at])
        if domain and local and not domain.group().lower().endswith(_FILES):
            spans.append((at - len(local.group()), domain.end(), "email"))
        at = text.find("@", at + 1)
    if not any(mark in text for mark in _AT_SIGNS):
        return
    for m in _AT_MARK.finditer(text):
        domain, local = _HIDDEN_DOMAIN.match(text, m.end()), _LOCAL.search(text[max(0, m.start() - 64) : m.start()])
        if domain and local:
            spans.append((m.start() - len(local.group()), domain.end(), "email"))


def _address(text: str, start: int) -> tuple[int, int] | None:
    """The address whose first number is at a place."""
    m = _EN.match(text, start)
    if m:
        unit = _BEFORE_UNIT.search(text, max(0, start - 24), start)
        return (unit.start() if unit else start), m.end()
    m = _FR.match(text, start)
    if m:
        return m.span()
    if start and text[start - 1] in " \xa0  ":
        low = max(0, start - 70)
        for before, number in ((_BOX, _BOX_NUMBER), (_DE_BEFORE, _DE_NUMBER), (_ES_BEFORE, _ES_NUMBER)):
            b = before.search(text, low, start)
            n = b and number.match(text, start)
            if n:
                return b.start(), n.end()
    return None


def _numbers(text: str, spans: list) -> None:
    """Identity numbers, phone numbers and addresses, from the runs of digits they hold."""
    done = 0
    for run in _RUN.finditer(text):
        start, end = run.span()
        if end <= done or _taken(start, end, spans):
            continue
        digits = sum(c.isdigit() for c in run.group())
        found = None
        if digits >= 5:
            first = start
            while not text[first].isdigit():
                first += 1
            letters = _LETTERS.search(text, max(0, first - 4), first)
            value = None
            for at in (letters.start(), first) if letters else (first,):
                if value is None and _LABEL_END.search(text, max(0, at - 52), at):
                    value = _VALUE.match(text, at)
            if value:
                found = (*value.span(), "id_number")
            elif not _NO_ID.search(text, max(0, start - 24), start):
                m = _ID_FORMS.search(text, max(0, start - 3), min(len(text), end + 3))
                if m and (m.end() == len(text) or not text[m.end()].isalnum()):
                    found = (*m.span(), "id_number")
                elif digits >= 9 and (p := _PHONE.search(text, start, min(len(text), end + 16))) and p.start() < end and not _DAY.match(p.group()):
                    found = (*p.span(), "phone")
        if found is None and digits < 12:
            for number in re.finditer(r"\d+", run.group()):
                at = start + number.start()
                before = text[at - 1] if at else " "
                if len(number.group()) <= 5 and not before.isalnum() and before not in ".-":
                    place = _address(text, at)
                    if place and place[0] >= done:
                        found = (*place, "address")
                        break
        if found and not _taken(found[0], found[1], spans):
            spans.append(found)
            done = found[1]


def find_items(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal items of a text, in order, without overlap; `given` is a given name alone."""
    spans: list[tuple[int, int, str]] = []
    _emails(text, spans)
    _numbers(text, spans)
    spans += _names(text, lexicon, spans)
    return sorted(spans)


# The corpus's own lexicon.

_DISPLAY = r'(?:^|[,;(])\s*"?([^"<>@,;()]+(?:,\s[^"<>@,;()]+)?)"?\s*(?:<|\))'


def learn_names(addresses: DataFrame, given_names: DataFrame | None = None) -> DataFrame:
    """(kind, name), kind g or f, of the display names of a column `address` of address lists."""
    shown = addresses.where("address is not null").select(F.explode(F.array_distinct(F.regexp_extract_all("address", F.lit(_DISPLAY), F.lit(1)))).alias("n"))
    shown = shown.select(F.trim(F.regexp_replace("n", r"\s+", " ")).alias("n")).where(r"n rlike '^[^\\d/:]{2,60}$'").distinct()
    comma = F.col("n").contains(",")
    given = F.when(comma, F.regexp_extract("n", r",\s*([^\s.]{2,})", 1)).otherwise(F.regexp_extract("n", r"^([^\s.]{2,})\s", 1))
    family = F.when(comma, F.regexp_extract("n", r"^([^,]+),", 1)).otherwise(F.regexp_extract("n", r"^[^\s.]{2,}\s+(?:\S\.\s*)*(.+)$", 1))
    both = shown.select(F.explode(F.array(F.struct(F.lit("g").alias("kind"), given.alias("name")), F.struct(F.lit("f").alias("kind"), family.alias("name")))).alias("x"))
    names = both.select("x.kind", F.trim("x.name").alias("name"))
    if given_names is not None:
        names = names.unionByName(given_names.select(F.lit("g").alias("kind"), F.trim("given_name").alias("name")))
    return names.where(rf"name rlike '^(?:\\p{{Ll}}+ )*\\p{{Lu}}[\\p{{L}}’\'\\-]+$' and length(name) > 1").distinct()


def _rows_with_names(df: DataFrame, names: DataFrame, fields: list[str]) -> tuple[DataFrame, object]:
    """The rows with a column of names to look up, and the broadcast lexicon if it is small enough."""
    ship(df.sparkSession)
    few = names.limit(MAX_NAMES + 1).count() <= MAX_NAMES
    if few:
        lexicon = df.sparkSession.sparkContext.broadcast(Lexicon.of([tuple(r) for r in names.collect()]))
        return df.withColumn("_names", F.lit(None).cast("array<struct<kind:string,name:string>>")), lexicon
    keyed = df.withColumn("_row", F.xxhash64(*fields))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, *texts in batch.itertuples(index=False):
                words = {w for text in texts if text for w, _, _ in _capitals(text)}
                words |= {part for w in words if "-" in w for part in w.split("-")}
                out += [(row, w) for w in words if w]
            yield pd.DataFrame(out, columns=["_row", "word"])

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, name in batch.itertuples(index=False):
                last = name.rpartition(" ")[2]
                out += [(kind, name, word) for word in {last, last.upper()}]
            yield pd.DataFrame(out, columns=["kind", "name", "word"])

    last = names.select("kind", "name").mapInPandas(forms, "kind string, name string, word string")
    words = keyed.select("_row", *fields).mapInPandas(held, "_row long, word string")
    used = words.distinct().join(last, "word")
    used = used.groupBy("_row").agg(F.collect_set(F.struct("kind", "name")).alias("_names"))
    return keyed.join(used, "_row", "left").drop("_row"), None


def items(df: DataFrame, id_col: str, fields: list[str], names: DataFrame) -> DataFrame:
    """(id, field, start, end, kind, found_text, alone) of all items of the text columns, place by place.

    `alone` tells a given name without a family name.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), *(F.col(f).cast("string").alias(f) for f in fields))
    rows, sent = _rows_with_names(rows, names, fields)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            lists = batch["_names"] if sent is None else [None] * len(batch)
            own = sent.value if sent is not None else None
            for key, held, *texts in zip(batch["id"], lists, *(batch[f] for f in fields)):
                lexicon = own or Lexicon.of([(n["kind"], n["name"]) for n in (held if held is not None else [])])
                for name, text in zip(fields, texts):
                    if text:
                        for s, e, kind in find_items(text, lexicon):
                            alone = kind == "given"
                            out.append((key, name, s, e, "name" if alone else kind, text[s:e], alone))
            yield pd.DataFrame(out, columns=["id", "field", "start", "end", "kind", "found_text", "alone"])

    return rows.mapInPandas(find, "id string, field string, start int, end int, kind string, found_text string, alone boolean")


# Replacements.

# Surrogate given names by gender and for unknown gender, and parts of surrogate family names.
_WOMEN = "Ada Berta Carla Dina Elva Flora Gilda Hedda Ilse Jorun Karla Livia Mira Nella Odette Petra Romy Selma Tilda Ulla Vilma Wanda Xenia Yrsa Zelda".split()
_MEN = "Aldo Bernt Cyril Darius Edgar Fabio Gideon Henrik Igor Jasper Karsten Ludo Milan Nestor Otto Piet Quentin Rufus Silvan Tobias Ulrich Valter Wim Xaver Yannis".split()
_ANY = "Adri Bente Chris Dany Eike Finley Gerrit Helge Inge Jona Kim Lou Maris Nikola Ode Pauli Quin Reese Sascha Toni Uli Vanja Wynn Yael Zion".split()
_HEADS = "Ander Bel Cal Dorn Eck Fal Gar Hol Ing Jas Kol Lar Mar Nor Ost Per Rad Sal Tor Urs Val Wes Yar Zel".split()
_TAILS = "bach bury dale feld gard hart horn kamp land lund mann mere rup sen shaw ström ton vik wald worth".split()
# Given names whose ending does not tell their gender, and endings that do.
_KNOWN_WOMEN = frozenset(
    "agnes alice anne astrid beatrice birgit carmen carol charlotte chloé chloe claire doris edith elizabeth ellen esther gertrud grace gudrun helen heidi inés ines ingrid irene iris isabel"
    " jane jennifer joan joy judith karen katherine kathleen lily lucy margaret marie marion mary mercedes miriam nancy patricia pilar rachel rose ruth sarah sigrid simone sophie susan sylvie"
    " ursula valerie violet yvonne zoé zoe emily emma amy aisling ashling louise chantal margot".split()
)
_KNOWN_MEN = frozenset(
    "alex andré andrea andreas antoine arthur benjamin bernard bruno carlos charles christian daniel david denis diego dmitri edward emil enrique erik eric ernest ethan felix fernando filip"
    " francis frank friedrich george guy hans harry heinrich henry hugo ian ivan jack jacob jakob james javier jean joão john jonas jonathan jorge josé joseph joshua juan jürgen karl kevin"
    " klaus lars leo leon louis luca lucas luis luka lukas marc marco marcel mario mark martin mateo matteo matthew max michael miguel mika nicholas nikita noah oliver oscar pablo patrick paul"
    " pedro peter philip pierre rafael raj ralph raphael raymond rené richard robert roger rolf samuel sebastian sergio simon stefan stephen sven theo thomas tim timothy tom victor vincent walter"
    " wolfgang wei ryan liam".split()
)
_FEMALE = re.compile(r"(?:[^\Wo]a|ette|elle|ina|ine|trud|hild)$")
_MALE = re.compile(r"(?:us|os|[^\Wa]o|rd|rt|ert|bert|fried)$")
# Letters of other scripts for those of surrogates.
_CYRILLIC = str.maketrans("abcdefghijklmnopqrstuvwxyzöABCDEFGHIJKLMNOPQRSTUVWXYZ", "абцдефгхийклмнопкрстуввкызоАБЦДЕФГХИЙКЛМНОПКРСТУВВКЫЗ")
_GREEK = str.maketrans("abcdefghijklmnopqrstuvwxyzöABCDEFGHIJKLMNOPQRSTUVWXYZ", "αβκδεφγχιγκλμνοπκρστυβωξυζοΑΒΚΔΕΦΓΧΙΓΚΛΜΝΟΠΚΡΣΤΥΒΩΞΥΖ")


def gender(word: str) -> str:
    """f or m where a given name tells, else an empty text."""
    low = word.casefold()
    if low in _KNOWN_WOMEN or low in _KNOWN_MEN:
        return "f" if low in _KNOWN_WOMEN else "m"
    return "f" if _FEMALE.search(low) else "m" if _MALE.search(low) else ""


def _in_script(made: str, like: str) -> str:
    """Letters of a surrogate in the script of the word it stands for."""
    if any("Ѐ" <= c <= "ӿ" for c in like):
        return made.translate(_CYRILLIC)
    return made.translate(_GREEK) if any("Ͱ" <= c <= "Ͽ" for c in like) else made


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(parts).encode(), "sha256")[:12], "big")


def canonical(kind: str, found: str) -> str:
    """The form under which items of a kind are the same."""
    if kind in ("name", "given"):
        return found.casefold()
    if kind == "address":
        return re.sub(r"\W+", " ", found).casefold().strip()
    if kind == "email":
        plain = re.sub(_AT, "@", found, count=0 if "@" not in found else 1)
        return re.sub(_DOT, ".", plain).replace(" ", "").casefold()
    return re.sub(r"\W", "", found).upper()


def _shaped(key: bytes, kind: str, seed: str, found: str) -> str:
    """A text of the same form: digits for digits, letters for letters of the same case and script."""
    n = _number(key, kind, seed)
    out = []
    for c in found:
        if c.isdigit():
            n, d = divmod(n, 10)
            out.append(str(d))
        elif c.isalpha():
            n, d = divmod(n, 26)
            base = "A" if c.isupper() else "a"
            if "А" <= c <= "я":
                base = "А" if c.isupper() else "а"
            elif "α" <= c.lower() <= "ω":
                base, d = ("Α" if c.isupper() else "α"), d % 17
            out.append(chr(ord(base) + d))
        else:
            out.append(c)
        if n < 1000:
            n = _number(key, kind, seed, str(len(out)))
    return "".join(out)


@lru_cache(200_000)
def _name_word(key: bytes, word: str, given: bool, salt: int) -> str:
    """The surrogate of a name's word; each salt has a syllable more, so that the space grows with the collisions."""
    n = _number(key, "g" if given else "f", word.casefold(), str(salt))
    if given:
        names = {"f": _WOMEN, "m": _MEN, "": _ANY}[gender(word)]
        n, a = divmod(n, len(names))
        n, b = divmod(n, 4 * len(_TAILS))
        out = names[a] + ("" if b % 4 == 0 else _TAILS[b // 4][:2])
    else:
        n, a = divmod(n, len(_HEADS))
        n, b = divmod(n, len(_HEADS))
        n, c = divmod(n, len(_TAILS))
        out = _HEADS[a] + _HEADS[b].lower() + _TAILS[c]
    for _ in range(salt):
        n, d = divmod(n, len(_HEADS))
        out += _HEADS[d].lower()
    out = _in_script(out, word)
    return out.upper() if word.isupper() and len(word) > 1 else out


def _email_like(key: bytes, seed: str, found: str, more: str) -> str:
    """An address of the same form: letters and digits replaced, signs and disguise kept, the last label being `example`."""
    local, sign, host = found.partition("@")
    if sign and not any(c in found for c in " ([\xa0\t") and " DOT" not in host:  # no disguise
        host, dot, _ = host.rpartition(".")
        return _shaped(key, "email", seed, f"{local}{more}@{host}") + dot + "example"
    at = re.search(_AT if "@" not in found or _AT_MARK.search(found) else "@", found)
    local, sign, domain = found[: at.start()], at.group(), found[at.end() :]
    labels = re.split(f"({_DOT})", domain)
    host = "".join(labels[:-1])
    shaped = _shaped(key, "email", seed, local + more + "\x00" + re.sub(_DOT, lambda m: "\x01", host))
    local, _, host = shaped.partition("\x00")
    dots = iter(labels[1::2])
    return local + sign + "".join(next(dots) if c == "\x01" else c for c in host) + "example"


@lru_cache(1000)
def _initial(key: bytes, letter: str) -> str:
    """An initial's surrogate: a keyed order of the alphabet, so that different initials stay different."""
    letters = [c for c in _INITIALS if c.isascii() == letter.isascii()]
    order = sorted(letters, key=lambda c: _number(key, "initial", c))
    return order[letters.index(letter)] if letter in letters else letter


_INITIALS = "".join(c for c in map(chr, range(65, 0x17F)) if re.match(f"[{_U}]", c))


@lru_cache(100_000)
def name_parts(kind: str, found: str) -> list[tuple[str, str]]:
    """(role, text) of the parts of a name: g given and f family names, i initials, and what lies between as it is."""
    words = re.findall(rf"{_W}[\w’'\-]*\.?|[^\w]+|\d+", found)
    plain = [k for k, w in enumerate(words) if w[0].isalpha() and not w.endswith(".") and w[0].isupper()]
    first = plain and (plain[-1] if "," in found else plain[0] if len(plain) > 1 or kind == "given" else None)
    return [("" if not w[0].isalpha() else "i" if w.endswith(".") else "" if k not in plain else "g" if k == first else "f", w) for k, w in enumerate(words)]


def _address_like(key: bytes, seed: str, found: str) -> str:
    """An address of the same form: numbers, codes and each word of the street's name replaced; street types, particles and unit words stay."""
    place = 0

    def next_seed() -> str:
        nonlocal place
        place += 1
        return f"{seed}\x1f{place}"

    def code(m: re.Match) -> str:
        head = m.group(1) or ""
        return head + _shaped(key, "address", next_seed(), m.group()[len(head) :])

    def word(m: re.Match) -> str:
        n, a = divmod(_number(key, "address", next_seed()), len(_HEADS))
        n, b = divmod(n, len(_HEADS))
        out = _HEADS[a] + _HEADS[b].lower() + _TAILS[n % len(_TAILS)]
        return out.upper() if m.group().isupper() and len(m.group()) > 1 else out

    box = _BOX_WHOLE.fullmatch(found)
    if box:
        return box.group(1) + _CODES.sub(code, box.group(2))
    unit = _UNIT_FIRST.match(found)
    at = unit.end() if unit else 0
    for form in _STREET_FORMS:
        m = form.fullmatch(found, at)
        if m:
            start, end = m.span("name")
            return _CODES.sub(code, found[:start]) + _NAME_WORD.sub(word, found[start:end]) + _CODES.sub(code, found[end:])
    return _NAME_WORD.sub(word, _CODES.sub(code, found))


def surrogate(key: bytes, kind: str, found: str, salts: dict | None = None) -> str:
    """A keyed replacement of the same kind and form; salts are those of items, for names of their words."""
    if kind in ("g", "f"):
        return _name_word(key, found, kind == "g", (salts or {}).get((kind, found.casefold()), 0))
    salt = (salts or {}).get((kind, canonical(kind, found)), 0)
    seed = f"{canonical(kind, found)}\x1f{salt}" if salt else canonical(kind, found)
    more = "0" * max(0, salt - 3)  # room where all numbers of the form are taken
    if kind == "email":
        return _email_like(key, seed, found, more)
    if kind == "phone":
        head = re.match(r"\+\d{1,3}|00\d{1,2}(?=\D)|\(?0", found)
        kept = head.group() if head else ""
        return kept + _shaped(key, kind, seed, found[len(kept) :] + more)
    if kind in ("name", "given"):
        out = []
        for role, w in name_parts(kind, found):
            if role == "i":
                w = "".join(_initial(key, c) if c.isupper() else c for c in w)
            elif role:
                w = _name_word(key, w, role == "g", (salts or {}).get((role, w.casefold()), 0))
            out.append(w)
        return "".join(out)
    if kind == "address":
        return _address_like(key, seed, re.sub(r"\d+", lambda m: m.group() + more, found, count=1))
    return _shaped(key, kind, seed, found + more)


def collisions(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, item, salt), the salts above 0 with which no two items have one surrogate, after `found` of items().

    Names are told apart by their words, kinds g and f, so that a word has one surrogate in
    all names. Of the items that meet, the one with the lowest salt, then the first, keeps
    its surrogate and the others take the next salt, until none meet.
    """
    schema = "kind string, item string, found string, salt int, made string"

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for kind, item, text, salt, before in batch[["kind", "item", "found", "salt", "made"]].itertuples(index=False):
                like = "name" if kind in ("g", "f") else kind
                made.append(before or canonical(like, surrogate(key, kind, text, {(kind, item): salt} if salt else None)))
            yield batch.assign(made=made)[["kind", "item", "found", "salt", "made"]]

    rows = found.select("kind", "found_text", "alone").distinct().mapInPandas(_units, "kind string, item string, found string")
    rows = rows.groupBy("kind", "item").agg(F.min("found").alias("found")).select("*", F.lit(0).alias("salt"), F.lit(None).cast("string").alias("made"))
    space = F.when(F.col("kind").isin("g", "f"), "name").otherwise(F.col("kind"))
    state = cut(rows.mapInPandas(make, schema))
    while True:
        shared = state.groupBy(space.alias("space"), "made").agg(F.min(F.struct("salt", "kind", "item")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        if shared.isEmpty():
            break
        held = state.withColumn("space", space).join(shared.select("space", "made", "keeps"), ["space", "made"], "left")
        meets = F.col("keeps").isNotNull() & (F.struct("salt", "kind", "item") != F.col("keeps"))
        again = held.select("kind", "item", "found", F.when(meets, F.col("salt") + 1).otherwise(F.col("salt")).alias("salt"), F.when(~meets, F.col("made")).alias("made"))
        state = cut(again.mapInPandas(make, schema))
    return state.where("salt > 0").select("kind", "item", "salt")


def shared_surrogates(found: DataFrame, key: bytes, salts: DataFrame | None) -> DataFrame:
    """(kind, items, shared): distinct items of each kind, names by their words, and surrogates that two of them share."""
    rows = found.select("kind", "found_text", "alone").distinct().mapInPandas(_units, "kind string, item string, found string")
    rows = rows.groupBy("kind", "item").agg(F.min("found").alias("found"))
    rows = rows.join(salts, ["kind", "item"], "left") if salts is not None else rows.withColumn("salt", F.lit(None).cast("int"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for kind, item, text, salt in batch[["kind", "item", "found", "salt"]].itertuples(index=False):
                salts_ = None if pd.isna(salt) else {(kind, item): int(salt)}
                made.append(("name" if kind in ("g", "f") else kind, canonical("name" if kind in ("g", "f") else kind, surrogate(key, kind, text, salts_))))
            yield pd.DataFrame(made, columns=["kind", "made"])

    made = rows.mapInPandas(make, "kind string, made string").groupBy("kind", "made").agg(F.count("*").alias("n"))
    return made.groupBy("kind").agg(F.sum("n").alias("items"), F.count_if(F.col("n") > 1).alias("shared"))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The things that get a surrogate each, of items() or of rows with a key: names by their words."""
    for batch in batches:
        out = set()
        for row in batch.itertuples(index=False):
            if row.kind == "name":
                parts = name_parts("given" if row.alone else row.kind, row.found_text)
                out |= {(*row[:-3], role, w.casefold(), w.casefold()) for role, w in parts if role in ("g", "f")}
            else:
                out.add((*row[:-3], row.kind, canonical(row.kind, row.found_text), row.found_text))
        yield pd.DataFrame(sorted(out), columns=[*batch.columns[:-3], "kind", "item", "found"])


def _rows_with_salts(df: DataFrame, names: DataFrame, fields: list[str], salts: DataFrame | dict | None) -> tuple[DataFrame, object]:
    """The rows with a column of salts to look up, and the broadcast salts if they are few enough."""
    none = F.lit(None).cast("array<struct<kind:string,item:string,salt:int>>")
    if salts is None or isinstance(salts, dict):
        return df.withColumn("_salts", none), df.sparkSession.sparkContext.broadcast(salts or {})
    few = salts.limit(MAX_NAMES + 1).collect()
    if len(few) <= MAX_NAMES:
        return df.withColumn("_salts", none), df.sparkSession.sparkContext.broadcast({(r.kind, r["item"]): r.salt for r in few})
    keyed = df.withColumn("_key", F.xxhash64(*fields))
    found = items(keyed.dropDuplicates(["_key"]), "_key", fields, names).select(F.col("id").cast("long").alias("_key"), "kind", "found_text", "alone")
    held = found.mapInPandas(_units, "_key long, kind string, item string, found string").join(salts, ["kind", "item"])
    held = held.groupBy("_key").agg(F.collect_set(F.struct("kind", "item", "salt")).alias("_salts"))
    return keyed.join(held, "_key", "left").drop("_key"), None


def replaced(df: DataFrame, fields: list[str], names: DataFrame, key: bytes, how: str = "placeholder", salts: DataFrame | dict | None = None) -> DataFrame:
    """The frame with the items of the text columns replaced and all else unchanged.

    `placeholder` writes [KIND_code], the code being keyed; `surrogate` writes a surrogate.
    """
    kept = [c for c in df.columns if c not in fields]
    rows, salted = _rows_with_salts(df.select(F.struct(*kept).alias("_kept"), *(F.col(f).cast("string").alias(f) for f in fields)), names, fields, salts)
    rows, sent = _rows_with_names(rows, names, fields)

    def put(kind: str, found: str, own: dict) -> str:
        if how == "surrogate":
            return surrogate(key, kind, found, own)
        kind = "name" if kind == "given" else kind
        return f"[{kind.upper()}_{_number(key, kind, canonical(kind, found)) % 16**20:020x}]"

    def write(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        once = lru_cache(100_000)(lambda kind, found: put(kind, found, salted.value)) if salted is not None else None
        for texts, held, with_salts in batches:
            yield written(texts, held, with_salts, once)

    def written(texts: pd.Series, held: pd.Series, with_salts: pd.Series, once) -> pd.Series:
        out = []
        for text, own, mine in zip(texts, held, with_salts):
            if not text:
                out.append(text)
                continue
            replace_ = once
            if replace_ is None:
                salts_ = {(x["kind"], x["item"]): x["salt"] for x in (mine if mine is not None else [])}
                replace_ = lambda kind, found: put(kind, found, salts_)  # noqa: B023, E731
            lexicon = sent.value if sent is not None else Lexicon.of([(n["kind"], n["name"]) for n in (own if own is not None else [])])
            parts, at = [], 0
            for s, e, kind in find_items(text, lexicon):
                parts += [text[at:s], replace_(kind, text[s:e])]
                at = e
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(write, "string")
    done = rows.select("_kept", *(udf(F.col(f), F.col("_names"), F.col("_salts")).alias(f) for f in fields))
    return done.select(*(F.col("_kept").getField(c).alias(c) if c in kept else F.col(c) for c in df.columns))
