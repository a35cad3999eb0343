"""Personal information inside free text (problem 10): a semi-Markov conditional random field.

Whole spans are scored: a grammar proposes candidate segments of bounded length, features of the whole
span and its surroundings score each one for its type, and dynamic programming over the candidates
chooses boundaries and types jointly. The weights are fitted here, by gradient steps on the exact
log-likelihood of the segmentation, on invented sentences from the generator below. Its frames, nouns and number
formats are general ones; words come from a public vocabulary file or are made up of syllables.

Names are proposed by their shape - two or three words that are not function words, in title case or unlike common
words, with initials, particles and hyphens - and by titles and cue words before them. Whether a word is a common one
(its lower-case form is a token of the vocabulary), a proper one (only its title-case form is) or an unknown one is a
feature, and so is a list of frequent given names; no list decides.
"""

from __future__ import annotations

import base64
import math
import os
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Invented sentences the weights are fitted on, passes over them, and the seed of the generator.
TRAIN_SENTENCES, EPOCHS, SEED = 8000, 3, 7
#: Folder of the public vocabulary files, and the files whose words count as known.
VOCABULARIES, KNOWN_WORDS = "/opt/tokenizers", ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")

# Word lists of the grammar (lower case).
GIVEN_NAMES = frozenset("""
adam ahmed aisha alan albert alejandro alex alexander ali alice amara amina amy ana andrea andrew angela anja anna anne antonio
arthur barbara beatriz ben bernd carlos carmen carol caroline charles chen chloe chris christian christine clara claudia daniel
david deborah diana diego dieter elena eleanor elisa elizabeth ella emil emily emma eric esther eva fatima felix fernando finn
francisco frank gabriel george grace greta hannah hans hassan heidi helen henry hiroshi hugo ibrahim ines ingrid irene isabel
ivan jack jakob james jan jane javier jennifer jessica joan john jonas jorge jose joseph juan julia julian karen karl kate
kevin klaus laura lena leo leon linda lisa louis lucas lucia lucy luis lukas luz manuel marco maria marie mario mark marta
martin mary matteo max maya mehmet mei mia michael miguel mohammed monika nadia nina noah nora oliver olivia omar oscar pablo
pamela patricia paul paula pedro peter petra philip priya rafael raj rebecca richard robert rosa ruth samuel sandra sara sarah
sergio simon sofia sophie stefan stephen susan sven teresa thomas tom ursula valentina victor walter william wolfgang yuki yusuf
""".split())
FUNCTION_WORDS = frozenset("""
qué quién quiénes cómo cuándo dónde cuál porque antes después entonces aquí allí todo toda todos todas otro otra este esta estos estas
wer wen wem wessen wohin woher zuerst danach davor weil dass daß denn doch jeder jede jedes kein keine man mal schon jetzt immer wieder sehr
uh um erm eh er ah oh hm hmm mm äh ähm öh
every each another such only own through into onto between without within against yes okay ok hello hi dear well sure hence thus
a about after again all also am an and are around as ask asked at back be because before best but by call can could did do does
during else ever first for from had has have he her here hier him his how i if in is it its joined kind last late left list look me met
my never new next no nobody nor not now of off on one or our out over please put said same says see she signed so some speaking
still than thank thanks that the their them then there these they this to today twice under until up us was we went were what
when where whether which while who why will with would yesterday you your monday tuesday wednesday thursday friday saturday sunday
al ayer con cuando de del dijo donde dos el ella en era es esta este firmó fue ha hablé hoy la las lo los luego más me mi muy no
para pero por que se si sin sobre soy su también tiene un una vive y ya aber am an auf aus bei das dem den der des die dann du ein
eine er es gestern hat heute ich ihr im ist kommt mit nach nicht noch oder sie sind über um und uns unter unterschrieben vom von vor
war warum was wie will wir wird wohnt zu zum zur zweimal dot punkt punto arroba
""".split())
TITLES = frozenset("dr mr mrs ms miss prof professor herr frau señor señora sr sra don doña".split())
PARTICLES = frozenset("de del la las los da dos van von der den di du bin ibn al el ter y zu".split())
ARTICLES = frozenset("the a an this that these those der die das den dem ein eine el la los las un una our your their my his her its every each".split())
PLACE_WORDS = frozenset("in near towards outside around across nach aus bei en desde hacia cerca".split())
PLACE_NOUNS = frozenset("""harbor harbour bay beach island islands valley falls springs heights cape point creek city town station airport square
street road avenue bridge river lake park forest mountain hill hills castle hall museum university college hotel church platz see insel plaza""".split())
NAME_CUES = frozenset("""with is by thank thanks ask call called named name signed speaking regards attention attn sincerely author
contact mit von ist heiße heisst gruß grüße nombre llamo llama firma firmado con soy es saludos atentamente and und y""".split())
ID_CUES = frozenset("""passport identity id social security national card pass ausweis personalausweis ausweisnummer reisepass pasaporte identidad dni nie
ssn nif steuernummer steuer cpf licence license insurance tax fiscal citizen resident registration""".split())
PHONE_CUES = frozenset("""call text phone tel telephone telefon teléfono telefono mobile ring ruf rufen anrufen telefonnummer llame llama llamar llámame contact
fax cell cellphone móvil handy whatsapp reach dial sms hotline""".split())
ADDRESS_CUES = frozenset("""address lives live flat apartment home house residence street moved deliver send ship parcel letter at to anschrift adresse
wohnt wohnen umgezogen dirección direccion domicilio vive vivo""".split())
EMAIL_CUES = frozenset("email mail e-mail mailto write to address reply-to correo contact".split())
CODE_CUES = frozenset("""order invoice serial version build ticket case model part item page room flight batch lot code key token reference sum total count
score row line section chapter unit edition number group step release revision nummer version zeile seite raum gruppe
número versión línea página sala grupo""".split())

# The grammar of addresses, e-mail, phone and identity numbers.
H = r"[^\S\r\n]"
W = r"[^\W\d_]+"
NAME_WORD = rf"{W}(?:['’\-]{W})*"
HOUSE = r"\d{1,4}(?:[-–/]\d{1,4})?(?:\s?[a-hA-H])?(?![\w])"
UNIT = rf"(?:flat|apartment|apt|unit|suite|ste|piso|wohnung|whg){H}?\.?{H}?#?\d{{1,4}}[a-z]?(?!\w)"
EN_SUFFIX = r"(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|row|place|pl|boulevard|blvd|way|terrace|square|sq|close|crescent|parkway|highway)"
DE_STREET = r"[^\W\d_]{2,}(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|steig)"
DE_PHRASE = rf"(?:(?:am|an{H}der|an{H}den|im|zum|zur|auf{H}der|unter{H}den|alte|neue|große|kleine){H}{NAME_WORD}(?:{H}{NAME_WORD})?|{NAME_WORD}{H}(?:straße|strasse|str\.|weg|platz|allee))"
ES_STREET = rf"(?:c/{H}?|(?:calle|avenida|avda|av|plaza|paseo|pza|camino|ronda|carrera|travesía)(?!\w)\.?{H}{{1,2}})(?:(?:de|del|de{H}la|de{H}los|de{H}las|la|el|los){H})?{NAME_WORD}(?:{H}{NAME_WORD}){{0,2}}"
BOX = r"(?:p\.?\s?o\.?\s?box|postfach|apartado(?:\sde\scorreos)?|casilla)"
TOWN = rf"{NAME_WORD}(?:{H}{NAME_WORD}){{0,2}}"
POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|\d{4,5}(?:-\d{3,4})?)(?![\w])"
COMMA = rf"{H}?,{H}?"
STREETS = {
    "en": re.compile(rf"{HOUSE}{H}{NAME_WORD}(?:{H}{NAME_WORD}){{0,2}}?{H}{EN_SUFFIX}(?!\w)\.?(?:{COMMA}{UNIT})?", re.I),
    "de": re.compile(rf"{DE_STREET}{H}{HOUSE}", re.I),
    "dephrase": re.compile(rf"{DE_PHRASE}{H}{HOUSE}", re.I),
    "es": re.compile(rf"{ES_STREET}{H}?,?{H}?(?:n[º°o]\.?{H}?)?{HOUSE}(?:{COMMA}\d{{1,2}}{H}?[ºª°]{H}?[a-z]?(?!\w))?", re.I),
    "box": re.compile(rf"{BOX}{H}?#?\d{{1,6}}(?!\w)", re.I),
}
#: What a line must contain, in lower case, for a pattern to be tried on it.
STREET_SIGNS = {
    "en": re.compile(r"\s(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|row|place|pl|boulevard|blvd|way|terrace|square|sq|close|crescent|parkway|highway)(?!\w)"),
    "de": re.compile(r"(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm|steig)\s\d"),
    "dephrase": re.compile(r"\b(?:am|an\sde[rn]|im|zum|zur|auf\sder|unter\sden|alte|neue|große|kleine)\s|\s(?:straße|strasse|str\.|weg|platz|allee)\s"),
    "es": re.compile(r"c/|\b(?:calle|avenida|avda|av|plaza|paseo|pza|camino|ronda|carrera|travesía)\b"),
    "box": re.compile(r"box|postfach|apartado|casilla"),
}
UNIT_BEFORE = re.compile(rf"(?<!\w){UNIT}{COMMA}$", re.I)
LINE = re.compile(r"[^\n]+")
TAILS = [re.compile(rf"{COMMA}{TOWN}{H}{POST}", re.I), re.compile(rf"{COMMA}{POST}{H}{TOWN}", re.I), re.compile(rf"{COMMA}{TOWN}", re.I), re.compile(rf"{COMMA}{POST}", re.I)]
ATOM = r"[^\W_](?:[\w+\-]*[^\W_])?"
DOT = rf"(?:\.|{H}*[\[(]{H}*(?:dot|punkt|punto){H}*[\])]{H}*|{H}+(?:dot|punkt|punto){H}+)"
AT = rf"(?:@|{H}*[\[(]{H}*(?:at|arroba){H}*[\])]{H}*|{H}+(?:at|arroba){H}+)"
EMAIL = re.compile(rf"(?<![\w.+\-@]){ATOM}(?:{DOT}{ATOM})*{AT}{ATOM}(?:{DOT}{ATOM})*{DOT}[^\W\d_]{{2,}}(?![\w@])", re.I)
MAYBE_EMAIL = re.compile(r"@|[\[(]\s*(?:at|arroba)\s*[\])]|\s(?:at|arroba)\s[^\n]{1,80}?\s(?:dot|punkt|punto)\s", re.I)
DIGITS = re.compile(r"\d+")
DIGIT_CHAIN = re.compile(r"\d[\d .()/\-]{5,}\d")
CODE = re.compile(r"(?<![\w.@#-])(?:[A-Za-z]{1,3}-?\d{6,9}(?:-?[A-Za-z])?|[A-Za-z]\d{2,3} \d{3,4} \d{2,4}|\d{7,9}-?[A-Za-z])(?![\w@]|-\w)")
WORDS = re.compile(W)
CLOCK = re.compile(r"\d:\d\d(?::\d\d)?(?:[.,]\d+)?[\])]?[ \t]+$")
TYPES = ("email", "phone", "id_number", "address", "person_name")


class Segment(tuple):
    """(start, end, type, features)"""

    __slots__ = ()


def _before(text: str, at: int, n: int = 4) -> list[str]:
    """The last n words before a place, nearest first, on the same line."""
    left = text[max(0, at - 60) : at].rsplit("\n", 1)[-1]
    return [w.lower() for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", left)][::-1][:n]


def _cues(words: list[str], kind: str, lists: dict[str, frozenset]) -> list[str]:
    out = []
    for name, cue in lists.items():
        for k, w in enumerate(words):
            if w in cue:
                out.append(f"{kind}:cue:{name}:{min(k, 2)}")
                break
    return out


def _edges(text: str, s: int, e: int, kind: str) -> list[str]:
    """How the span sits in the text: what touches it on either side."""
    left, right = text[s - 1 : s], text[e : e + 1]
    out = [f"{kind}:touch:left" for _ in (1,) if left and (left.isalnum() or left in "_@")] + [f"{kind}:touch:right" for _ in (1,) if right and (right.isalnum() or right in "_@")]
    if re.match(r"[ .\-/]?\(?\d", text[e : e + 3]):
        out.append(f"{kind}:more:right")
    if re.search(r"\d\)?[ .\-]?\(?$", text[max(0, s - 4) : s]):
        out.append(f"{kind}:more:left")
    return out


def _email_matches(text: str, at: int, stop: int) -> Iterator[re.Match]:
    """Every place an address may begin at; spelled out, the words before it can look like a part of it."""
    while m := EMAIL.search(text, at, stop):
        yield m
        at = m.end() if m.group().count("@") == 1 and " " not in m.group() else m.start() + 1


def email_segments(text: str) -> Iterator[Segment]:
    lines = [m.span() for m in LINE.finditer(text) if MAYBE_EMAIL.search(m.group())] if "@" in text or MAYBE_EMAIL.search(text) else []
    for m in (m for span in lines for m in _email_matches(text, *span)):
        body = m.group()
        f = ["email:bias", "email:at:" + ("sign" if "@" in body else "spelled"), "email:dots:" + ("spelled" if re.search(r"dot|punkt|punto", body, re.I) else "plain")]
        f += _cues(_before(text, m.start()), "email", {"email": EMAIL_CUES}) + _edges(text, m.start(), m.end(), "email")
        yield Segment((m.start(), m.end(), "email", f))


def number_segments(text: str) -> Iterator[Segment]:
    """Phone and identity numbers: every stretch of up to six digit groups that could be one."""
    chains = [[(m.start(), m.end()) for m in DIGITS.finditer(text, *chain.span())] for chain in DIGIT_CHAIN.finditer(text)]
    for groups, i in [(g, k) for g in chains for k in range(len(g))]:
        n = len(groups)
        s, shape, digits, seps = groups[i][0], [], 0, []
        if s and (text[s - 1].isalnum() or text[s - 1] in "_.,:@#" or (text[s - 1] == "-" and s > 1 and text[s - 2].isalnum())) and not (s > 1 and text[s - 1] == "." and text[s - 2] == " "):
            continue
        plus, paren = text[s - 1 : s] == "+", text[s - 1 : s] == "("
        start = s - 1 if plus or paren else s
        if paren and text[s - 2 : s - 1] == "+":
            start = s - 2
        for j in range(i, min(n, i + 6)):
            if j > i:
                gap = text[groups[j - 1][1] : groups[j][0]]
                if gap not in (" ", "-", ".", ") ", ")", " (", "/", " ", " - "):
                    break
                seps.append(gap)
            shape.append(groups[j][1] - groups[j][0])
            digits += shape[-1]
            if digits > 16:
                break
            if digits < 7 or paren and ")" not in "".join(seps):
                continue
            e = groups[j][1]
            kinds = set(seps)
            plain = "-".join(map(str, shape[1:] if plus else shape)) if len(shape) > 1 else f"run{digits}"
            words = _before(text, start)
            for kind, cues in (("phone", {"phone": PHONE_CUES, "id": ID_CUES, "code": CODE_CUES}), ("id_number", {"id": ID_CUES, "phone": PHONE_CUES, "code": CODE_CUES})):
                f = [f"{kind}:bias", f"{kind}:digits:{digits}", f"{kind}:groups:{len(shape)}", f"{kind}:plus:{plus}", f"{kind}:paren:{paren}", f"{kind}:last:{shape[-1]}", f"{kind}:first:{shape[0]}:{plus}"]
                f.append(f"{kind}:shape:{'+' if plus else ''}{plain}")
                f.append(f"{kind}:zero:{text[groups[i][0]] == '0'}:{plus}")
                f.append(f"{kind}:seps:{'mixed' if len(kinds) > 1 else (kinds.pop() if kinds else 'none')}")
                yield Segment((start, e, kind, f + _cues(words, kind, cues) + _edges(text, start, e, kind)))
                kinds = set(seps)
    for m in CODE.finditer(text):
        body = m.group()
        words = _before(text, m.start())
        f = ["id_number:bias", "id_number:code", "id_number:codeshape:" + re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "0", body))]
        yield Segment((m.start(), m.end(), "id_number", f + _cues(words, "id_number", {"id": ID_CUES, "phone": PHONE_CUES, "code": CODE_CUES}) + _edges(text, m.start(), m.end(), "id_number")))


def address_segments(text: str) -> Iterator[Segment]:
    """Addresses: a street with house number or a box, alone and with each tail of town and postcode."""
    whole = text.lower() + " "
    kinds = [k for k in STREETS if STREET_SIGNS[k].search(whole)]
    for line in LINE.finditer(text) if kinds else ():
        if DIGITS.search(line.group()):
            yield from _line_addresses(text, line.start(), line.end(), line.group().lower() + " ", kinds)


def _line_addresses(text: str, begin: int, stop_at: int, low: str, kinds: list[str]) -> Iterator[Segment]:
    ends_seen = set()
    for kind in kinds:
        if not STREET_SIGNS[kind].search(low):
            continue
        pattern = STREETS[kind]
        at = begin
        while m := pattern.search(text, at, stop_at):
            at = m.start() + 1
            s = m.start()
            if kind == "en":
                unit = UNIT_BEFORE.search(text, max(begin, s - 30), s)
                s = unit.start() if unit else s
            if s and (text[s - 1].isalnum() or text[s - 1] in "_-–.#") or kind == "en" and m.end() in ends_seen:
                continue
            ends_seen.add(m.end())
            base = ["address:bias", f"address:kind:{kind}"]
            inner = [w.lower() for w in WORDS.findall(m.group())]
            base += ["address:functionword"] if kind == "en" and any(w in FUNCTION_WORDS or w in CODE_CUES for w in inner[:-1]) else []
            base += ["address:functionword"] if kind == "dephrase" and len(inner) > 1 and inner[-1] in FUNCTION_WORDS else []
            base += _cues(_before(text, s), "address", {"address": ADDRESS_CUES, "code": CODE_CUES})
            ends = [(m.end(), "bare", "")]
            for k, tail in enumerate(TAILS):
                t = tail.match(text, m.end())
                if t:
                    words = list(WORDS.finditer(t.group()))
                    if k in (0, 1, 3):
                        ends.append((t.end(), ("townpost", "posttown", "", "post")[k], " ".join(w.group() for w in words)))
                    if k in (1, 2):  # the town may take one to three words
                        for w in words:
                            joined = t.group()[: w.end()]
                            ends.append((m.end() + w.end(), ("", "posttown", "town")[k], " ".join(WORDS.findall(joined))))
            for e, what, town in dict.fromkeys(ends):
                names = town.lower().split()
                f = [*base, f"address:tail:{what}", f"address:tail:{kind}:{what}"]
                if names:
                    f.append(f"address:townwords:{len(names)}")
                    f += ["address:townfunction"] if any(w in FUNCTION_WORDS or w in TITLES for w in names) else []
                    f += ["address:towncase"] if len({w[:1].isupper() for w in town.split()}) > 1 or (town[:1].isupper() != m.group()[-3:-1][:1].isupper() and kind == "en" and m.group().lower() != m.group() and not town[:1].isupper()) else []
                    f += ["address:townthing"] if any(w in CODE_CUES or w in PHONE_CUES or w in GIVEN_NAMES for w in names) else []
                if re.match(rf"{COMMA}(?:{POST})|{H}{POST}", text[e:], re.I):
                    f.append("address:postfollows")
                stop = len(text[:e].rstrip(".")) if text[e - 1] == "." else e
                yield Segment((s, stop, "address", f))


class Lexicon(dict):
    """What is known of a word as written: (lower case, function word, listed given name, capital, class, whether a name may
    begin with it whatever follows); class C is a common word (its lower-case form is in the vocabulary), P a proper one (only its
    title-case form is), U an unknown one."""

    def __init__(self, common: frozenset[str], proper: frozenset[str]) -> None:
        super().__init__()
        self.common, self.proper = common, proper

    def __missing__(self, word: str) -> tuple[str, bool, bool, bool, str, bool]:
        if len(self) > 300_000:
            self.clear()
        low = word.lower()
        kind = "C" if low in self.common else "P" if low in self.proper else "U"
        function, listed, capital = low in FUNCTION_WORDS or low in TITLES, low in GIVEN_NAMES, word[:1].isupper()
        got = self[word] = (low, function, listed, capital, kind, listed or len(word) == 1 or not function and (capital or kind != "C"))
        return got


_LEXICA: dict = {}


def known_words(folder: str = VOCABULARIES, files: tuple[str, ...] = KNOWN_WORDS) -> tuple[frozenset[str], frozenset[str]]:
    """The common and the proper words of the vocabularies, the first that knows a word deciding; empty sets where there are none, every word is unknown then."""
    key = (folder, files)
    if key not in _LEXICA:
        common: set[str] = set()
        proper: set[str] = set()
        for name in files:
            path = os.path.join(folder, name)
            if os.path.exists(path):
                with open(path, "rb") as lines:
                    tokens = (base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in lines)
                    whole = {x[1:] for x in tokens if len(x) > 3 and x[0] == " " and x[1:].isalpha()}
                here = {x for x in whole if x.islower()}
                common |= here - proper
                proper |= {x.lower() for x in whole if x.istitle()} - here - common
        _LEXICA[key] = frozenset(common), frozenset(proper)
    return _LEXICA[key]


_DEFAULT: list[Lexicon] = []


def default_lexicon() -> Lexicon:
    if not _DEFAULT:
        _DEFAULT.append(Lexicon(*known_words()))
    return _DEFAULT[0]


def name_features(form: str, given: str, family: str, case: str, before: str, after: str, hyphen: bool, particle: bool, place: bool) -> list[str]:
    """Features of a name: `given` and `family` are L (listed), C, P, U, or I for an initial; what stands before and after;
    whether it ends like the name of a place."""
    f = ["name:bias", f"name:form:{form}", f"name:words:{form}:{given}{family}", f"name:case:{case}", f"name:before:{before}", f"name:after:{after}"]
    f += [f"name:given:{given}:{case}", f"name:family:{family}:{case}", f"name:{given}{family}:{before}", f"name:{form}:{before}", f"name:{form}:{after}", f"name:{given}:{before}:{after}"]
    return f + ["name:hyphen"] * hyphen + ["name:particle"] * particle + ["name:place"] * place


def name_segments(text: str, lexicon: Lexicon) -> Iterator[Segment]:
    """Names: a given name or initials and a family name, in either order, by shape and surroundings."""
    words = [(m.start(), m.end(), m.group()) for m in WORDS.finditer(text)]
    n = len(words)
    info = [lexicon[w[2]] for w in words]

    def joined(i: int) -> bool:
        return i > 0 and words[i][0] - words[i - 1][1] == 1 and text[words[i - 1][1]] in "-'’"

    def after(i: int) -> int:
        """The index behind a word and its hyphenated parts."""
        j = i + 1
        while j < n and joined(j):
            j += 1
        return j

    def style(i: int) -> str:
        w = words[i][2]
        return ("I" if info[i][3] else "i") if len(w) == 1 else "U" if w.isupper() else "T" if info[i][3] else "l"

    def kind(i: int) -> str:
        return "I" if len(words[i][2]) == 1 else "L" if info[i][2] else info[i][4]

    def before(i: int) -> str:
        if not i:
            return "start"
        gap = text[words[i - 1][1] : words[i][0]]
        low = info[i - 1][0]
        if low in TITLES and gap in (" ", ". "):
            return "title"
        if len(words[i - 1][2]) == 1 and gap in (". ", "."):
            return "initial"
        if gap == " ":
            kinds = (("article", ARTICLES), ("place", PLACE_WORDS), ("cue", NAME_CUES))
            named = next((name for name, listed in kinds if low in listed), None)
            return named or ("function" if info[i - 1][1] else "capital" if info[i - 1][3] else "word")
        mark = gap.rstrip(" \t")[-1:] or " "
        if CLOCK.search(text, max(0, words[i][0] - 12), words[i][0]):
            return "start"
        if low in NAME_CUES and mark in (":", ","):
            return "cue"
        return "digit" if mark.isdigit() else "joined" if gap[-1:] in "@_.-/" and gap else "start" if mark in ".!?\n" else "mark"

    def behind(j: int) -> str:
        """What follows the word before index j."""
        e = words[j - 1][1]
        if text[e : e + 1] in ("@", "_", "-", "/") and text[e : e + 1]:
            return "joined"
        if j < n and text[e : words[j][0]] == " ":
            return "capital" if info[j][3] and not info[j][1] else "function" if info[j][1] else "common" if info[j][4] == "C" else "word"
        return "digit" if re.match(r" ?\d", text[e : e + 2]) else "mark"

    def emit(i: int, stop: int, form: str, given: int, family: int, end: int | None = None, particle: bool = False) -> Segment:
        case = style(given) + style(family)
        if "U" in case and any(0 <= x < n and len(words[x][2]) > 1 and words[x][2].isupper() for x in (i - 1, stop)):
            case += "V"  # the words around are in capitals too, so these say nothing
        f = name_features(form, kind(given), kind(family), case, before(i), behind(stop) if end is None else "mark", after(family) > family + 1, particle, info[family][0] in PLACE_NOUNS)
        return Segment((words[i][0], words[stop - 1][1] if end is None else end, "person_name", f))

    def fits(i: int) -> bool:
        return i < n and words[i][1] - words[i][0] >= 2 and not info[i][1]

    starts = [i for i in range(n) if info[i][5]]
    for i in [i for i in starts if info[i][2]]:  # a family name, even a common word, may stand before a listed name
        i -= 1
        while i > 0 and joined(i):
            i -= 1
        if i >= 0 and not info[i][5]:
            starts.append(i)
    for i in starts:
        low, function, listed, capital, cls, _ = info[i]
        j = after(i)
        if j >= n or joined(i):
            continue
        gap = text[words[j - 1][1] : words[j][0]]
        if words[i][1] - words[i][0] == 1:
            if gap in (". ", "."):
                if fits(j):
                    yield emit(i, after(j), "I.L", i, j)
                elif words[j][1] - words[j][0] == 1 and after(j) < n and text[words[j][1] : words[after(j)][0]] in (". ", ".") and fits(after(j)):
                    yield emit(i, after(after(j)), "I.I.L", i, after(j))
            continue
        if function and not listed:
            continue
        cued = i > 0 and (info[i - 1][0] in TITLES or info[i - 1][0] in NAME_CUES)
        if gap == " ":
            if words[j][1] - words[j][0] == 1 and info[j][3] == capital and (listed or capital or cls != "C"):
                k = after(j)
                dotted = k < n and text[words[j][1] : words[k][0]] == ". "
                if k < n and (dotted or info[j][3] and (capital or listed) and text[words[j][1] : words[k][0]] == " ") and fits(k):
                    yield emit(i, after(k), "FIL", i, k)
            k = j
            while k < n and k < j + 3 and info[k][0] in PARTICLES and text[words[k - 1][1] : words[k][0]] == " ":
                k += 1
            if k > j and (listed or capital or cued and cls != "C") and fits(k) and text[words[k - 1][1] : words[k][0]] == " " and (info[k][3] or not capital):
                yield emit(i, after(k), "FpL", i, k, particle=True)
            if fits(j):
                likely = listed or info[j][2] or capital and info[j][3] or cls != "C" and info[j][4] != "C" and capital == info[j][3] or cued and cls != "C" and capital == info[j][3]
                if likely:
                    yield emit(i, after(j), "FL", i, j)
                    k = after(j)
                    if k < n and fits(k) and text[words[k - 1][1] : words[k][0]] == " " and info[k][3] == info[j][3] and (info[k][3] or info[k][4] != "C" and listed):
                        yield emit(i, after(k), "FLL", i, k)
        elif gap == ", " and fits(j) and capital == info[j][3] and (info[j][2] or capital or cued and cls != "C" and info[j][4] != "C"):
            yield emit(i, after(j), "L,F", j, i)
            k = after(j)
            if k < n and text[words[k - 1][1] : words[k][0]] == " " and words[k][1] - words[k][0] == 1 and text[words[k][1] : words[k][1] + 1] == ".":
                yield emit(i, after(j), "L,FI", j, i, words[k][1] + 1)


def segments(text: str, lexicon: Lexicon | None = None) -> list[Segment]:
    """All candidate segments of a text, sorted by end."""
    found = [*email_segments(text), *number_segments(text), *address_segments(text), *name_segments(text, lexicon or default_lexicon())]
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def _lattice(found: list[Segment]) -> list[int]:
    """For each candidate the number of candidates that end at or before its start."""
    ends = [s[1] for s in found]
    return [bisect_right(ends, s[0]) for s in found]


def decode(found: list[Segment], weights: dict[str, float]) -> list[Segment]:
    """The best set of segments that don't overlap; text outside segments scores 0."""
    prior = _lattice(found)
    best, take = [0.0], []
    for k, seg in enumerate(found):
        score = best[prior[k]] + sum(weights.get(f, 0.0) for f in seg[3])
        take.append(score > best[k])
        best.append(max(best[k], score))
    out, k = [], len(found)
    while k:
        if take[k - 1]:
            out.append(found[k - 1])
            k = prior[k - 1]
        else:
            k -= 1
    return out[::-1]


def _marginals(found: list[Segment], weights: dict[str, float]) -> list[float]:
    """Probability of each candidate under the model, by forward and backward sums over the lattice."""
    return _chances(_lattice(found), [sum(weights.get(f, 0.0) for f in s[3]) for s in found])


def _chances(prior: list[int], score: list[float]) -> list[float]:
    """The same from the lattice and the scores of the candidates."""
    n, exp, log1p = len(prior), math.exp, math.log1p
    forward = [0.0] * (n + 1)
    for k in range(n):
        a, b = forward[k], forward[prior[k]] + score[k]
        forward[k + 1] = a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))
    backward = [-math.inf] * n + [0.0]
    for k in range(n, 0, -1):
        here = backward[k]
        for to, b in ((k - 1, here), (prior[k - 1], here + score[k - 1])):
            a = backward[to]
            backward[to] = a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))
    return [exp(min(0.0, forward[prior[k]] + score[k] + backward[k + 1] - forward[n])) for k in range(n)]


# ------------------------------------------------------------------ invented sentences
def _word(r: random.Random, syllables: int = 2) -> str:
    onset = "b c d f g h k l m n p r s t v w z br dr gl st tr pl qu sk".split()
    return "".join(r.choice(onset) + r.choice("a e i o u ae ea oi".split()) + r.choice(["", "", "l", "n", "r", "s", "x", "lt", "nd"]) for _ in range(syllables))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _drawn(r: random.Random, kind: str) -> str:
    """A word of a class, in lower case: listed given name, common or proper word of the vocabulary, or made up."""
    if kind == "L":
        return r.choice(_LISTS["given"])
    pool = _LISTS.get(kind)
    return r.choice(pool) if pool else _word(r, r.randint(2, 3))


_LISTS: dict[str, list[str]] = {"given": sorted(GIVEN_NAMES), "article": sorted(ARTICLES), "place": sorted(w.title() for w in PLACE_NOUNS), "code": sorted(CODE_CUES)}


def _fill_lists() -> None:
    common, proper = known_words()
    _LISTS["C"] = sorted(w for w in common if len(w) >= 4 and w not in FUNCTION_WORDS and w not in GIVEN_NAMES)
    _LISTS["P"] = sorted(w for w in proper if len(w) >= 4 and w not in FUNCTION_WORDS and w not in GIVEN_NAMES)


def _name(r: random.Random) -> str:
    given_kind = r.choices("LPU", [5, 2, 4])[0]
    family_kind = r.choices("UPC", [7, 3, 1 if given_kind == "L" else 0])[0]
    given, fam, i = _drawn(r, given_kind).title(), _drawn(r, family_kind).title(), r.choice("ABCDEFGHJKLMNPRSTVW")
    if r.random() < 0.2:
        fam += "-" + _word(r, 2).title()
    if r.random() < 0.08:
        given += "-" + _drawn(r, "L").title()
    forms = [f"{given} {fam}", f"{fam}, {given}", f"{given} {i}. {fam}", f"{i}. {fam}", f"{given} {r.choice(['de', 'van', 'de la', 'von', 'van der'])} {fam}", f"{given} {fam} {_drawn(r, 'U').title()}", f"{fam} {given}", f"{i}. {r.choice('ABCDEM')}. {fam}", f"{fam}, {given} {i}."]
    return r.choices(forms, [9, 3, 3, 3, 1, 0.5, 0.5 if given_kind == "L" else 0, 1, 0.7])[0]


def _email(r: random.Random) -> str:
    given = _drawn(r, "L")
    local = r.choice([_word(r), f"{given}.{_word(r)}", f"{given}-{_word(r)}", f"{_word(r)}_{given}+{_word(r, 1)}", f"{_word(r, 1)}.{_word(r)}", f"{_word(r, 1)}_{_word(r)}+{_word(r, 1)}", f"{_word(r, 1)}-{_word(r)}", f"{_word(r)}{r.randint(1, 99)}"])
    host = r.choice([f"{_word(r)}.{r.choice(['com', 'org', 'test', 'example', 'de'])}", f"{_word(r)}-lab.example", f"{_word(r)}.mail.test", f"{_word(r)}.invalid"])
    style = r.randrange(5)
    if style == 3:
        return f"{local.replace('.', ' dot ')} at {host.replace('.', ' dot ')}"
    return f"{local}{['@', '(at)', '@', '', ' [at] '][style]}{host.replace('.', ' [dot] ') if style == 4 else host}"


def _phone(r: random.Random) -> str:
    a, b, c = str(r.randint(200, 999)), _digits(r, 3), _digits(r, 4)
    return r.choice([
        f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 7{_digits(r, 3)} {_digits(r, 6)}", f"07{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}",
        f"020 {_digits(r, 4)} {_digits(r, 4)}", f"+49 {r.randint(30, 89)} {_digits(r, 8)}", f"0{r.randint(30, 89)} {_digits(r, 5)} {_digits(r, 3)}", f"+34 6{_digits(r, 2)} {_digits(r, 3)} {_digits(r, 3)}",
        f"0{r.randint(151, 179)} {_digits(r, 7)}", f"+44 20 {_digits(r, 4)} {_digits(r, 4)}", f"0{r.randint(30, 89)}/{_digits(r, 7)}", f"+{r.randint(30, 99)} {_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}",
    ])


def _identity(r: random.Random) -> str:
    x, y = r.choice("ABCDEFGHJKLMNPRSTVWXYZ"), r.choice("ABCDEFGHJKLMNPRSTVWXYZ")
    return r.choice([
        f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", f"{_digits(r, 3)} {_digits(r, 2)} {_digits(r, 4)}", f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)}-{_digits(r, 2)}",
        f"{x}{y}{_digits(r, 7)}", f"{x}{_digits(r, 7)}{y}", f"{x}-{_digits(r, 7)}-{y}", f"{x}{_digits(r, 3)} {_digits(r, 4)} {_digits(r, 2)}", f"{_digits(r, 8)}{x}", f"{x}{_digits(r, 8)}",
    ])


def _address(r: random.Random) -> str:
    street, town, post = _word(r, r.randint(2, 3)).title(), _word(r, r.randint(2, 3)).title(), _digits(r, 5)
    house = r.choice([str(r.randint(1, 250)), f"{r.randint(1, 200)}-{r.randint(201, 250)}", str(r.randint(1, 99))])
    suffix = r.choice(["Street", "St.", "Avenue", "Ave", "Road", "Drive", "Lane", "Court", "Row", "Place"])
    en = f"{house} {street} {suffix}"
    return r.choice([
        en, f"{en}, {town}", f"{en}, {town} {post}", f"Flat {r.randint(1, 9)}{r.choice('ABCD')}, {en}, {town}", f"{en}, Apt. {r.randint(1, 20)}, {town}", f"PO Box {r.randint(1, 300)}, {town} {post}",
        f"{street}{r.choice(['straße', 'weg', 'platz', 'gasse'])} {r.randint(1, 220)}{r.choice(['', 'a', 'd'])}", f"{street}{r.choice(['straße', 'weg'])} {r.randint(1, 220)}, {post} {town}", f"Am {street}platz {r.randint(1, 200)}, {post} {town}",
        f"Calle {street} {r.randint(1, 200)}, {r.randint(1, 9)}º {r.choice('ABCD')}, {post} {town}", f"Plaza {street} {r.randint(1, 200)}, {post} {town}", f"Avda. de {street}, {r.randint(1, 250)}", f"Calle {street} {r.randint(1, 99)}",
    ])


# Frames of the invented sentences.
CONTEXTS = {
    "person_name": ["{} bought two tickets.", "A parcel came for {} today.", "The keys are with {} now.", "Mr. {} paid the bill.", "Dr {} will see you.", "Frau {} hat angerufen.", "Herr {} war im Haus.", "La señora {} llega tarde.", "Signed by {}", "Hello, my name is {}.", "I am {} from the office.", "Best regards, {}", "Author: {}", "Name: {}", "{}", "This song is by {}.", "Yesterday {} closed the shop and left.", "Con {} fuimos al cine.", "Wir haben {} gefragt.", "Das Buch gehört {} allein.", "Did {} win?", "Everyone thanked {} for dinner.", "She handed the book to {}, who smiled.", "A letter from {} arrived.", "give this to {} please", "Wir gingen zu {} nach Hause.", "Le di la carta a {} ayer.", "well {} knows it", "so {} and the others stayed", "ah {} said no.", "Is that for {}?", "Gestern hatte {} Besuch.", "Morgen bekommt {} Blumen von uns.", "Dort war {} Lehrer.", "The photo was made by {}", "Was {} there too?", "It is {} again.", "Has {} paid?", "Hoy fue {} quien pagó.", "Aber {} kam nie an.", "The house that {} built fell down.", "How {} laughed!", "The painter {} died young.", "Der Maler {} starb jung.", "His sister {} sings.", "Only {} knew.", "We told {} everything.", "The answer went to {} first.", "Anoche llamó {} otra vez.", "Vor dem Haus stand {} allein.", "A note for {}, written in haste.", "Wir sahen {} im Garten.", "what did {} say", "as {} put it", "El libro es de {}.", "A friend called {} moved away.", "We met {} and {} at noon.", "{} and {} were late.", "Here speaks {}, good evening.", "hier spricht {}", "habla {}"],
    "email": ["Send a mail to {}.", "email: {}", "You can reach me at {}, thanks.", "Answer to {} soon.", "Mi correo es {}.", "Meine Adresse ist {}.", "{} bounced.", "<{}>"],
    "phone": ["Tel. {}", "Phone: {}", "Dial {} after six.", "My mobile number is {}, ok?", "Bitte {} anrufen.", "{} is the hotline.", "Mi teléfono es {}.", "Text me on {} later.", "The fax line is {}.", "Rufen Sie {} an.", "{}"],
    "id_number": ["Passport {} has expired.", "My identity number is {}.", "ID {}", "Personalausweis {} liegt vor.", "El pasaporte {} caducó.", "The tax number on file is {}.", "{} is on the card.", "Social security number {} was given.", "Her licence says {}.", "DNI {}"],
    "address": ["Deliver the parcel to {}.", "We live at {}.", "Address: {}", "Sie wohnt in {}.", "Vivimos en {}.", "They moved to {} in spring.", "{} was sold.", "Anschrift: {}", "The party is at {} tonight.", "A fire broke out at {} at noon.", "Home address {}", "Wir treffen uns {}.", "{}"],
}
VERBS = "opened closed found lost painted kept sold bought moved checked needs has was met took left".split()


def _noun(r: random.Random) -> str:
    return _drawn(r, "C")


def _thing(r: random.Random) -> str:
    """Something with a name that is no person: a common word in title case beside another word, often behind an article."""
    a, b = _noun(r).title(), _drawn(r, r.choice("UUP")).title()
    other, article = _drawn(r, r.choice("UUPC")).title(), r.choice(_LISTS["article"])
    return r.choice([
        lambda: f"{a} {b}", lambda: f"{b} {a}", lambda: f"{article} {b} {a}", lambda: f"{article} {a} {b}", lambda: f"{article} {b} {other}", lambda: f"{article} {other} {b}", lambda: f"{article} {b} {other} {_noun(r)}", lambda: f"the {b} {_noun(r)}", lambda: f"{a} {_noun(r).title()}", lambda: f"{article} {a} of {b}",
        lambda: f"{a} {b} {_noun(r).title()}", lambda: f"{b}", lambda: f"{b} {_noun(r)}", lambda: f"{a} {r.randint(1, 99)}", lambda: f"{_drawn(r, 'L').title()} {r.choice(_LISTS['place'])}",
    ])()


def _figure(r: random.Random) -> str:
    """A number that is neither a telephone nor an identity number."""
    n = r.randint(1, 999)
    chain = r.choice([" ", "-", ".", "/"]).join(_digits(r, r.randint(1, 5)) for _ in range(r.randint(2, 4)))
    alike = r.choice(" -").join(_digits(r, k) for k in [r.randint(2, 4)] * r.randint(2, 4))
    bank = f"{_word(r, 1)[:2].upper()}{_digits(r, 2)} " + " ".join(_digits(r, 4) for _ in range(r.randint(3, 5))) + f" {_digits(r, 2)}"
    return r.choice([lambda: str(n), lambda: f"{n}.{_digits(r, 3)}", lambda: chain, lambda: alike, lambda: alike, lambda: bank, lambda: " ".join(_digits(r, 4) for _ in range(4)), lambda: _digits(r, r.choice([4, 5, 6])), lambda: f"20{_digits(r, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: f"{_word(r, 1)}_{n}_{_digits(r, 3)}", lambda: f"{_word(r, 1).upper()[:2]}{n}_{_digits(r, 2)}", lambda: f"{r.randint(1, 9)}.{n}.{r.randint(0, 9)}"])()


def _foreign(r: random.Random) -> str:
    """A sentence of words that no vocabulary knows, as inflected forms often are: lower case but for the nouns of German."""
    u, big = lambda: _drawn(r, r.choice("UUUPC")), lambda: _drawn(r, r.choice("UUPPC")).title()
    name = _drawn(r, "U").title()
    return r.choice([
        lambda: f"{r.choice(['der', 'die', 'das', 'ein', 'eine'])} {big()} {u()} {r.choice(['den', 'die', 'das', 'mit', 'am'])} {big()} {r.choice(['der', 'des', 'von', 'zu', 'und', 'mit'])} {big()}", lambda: f"{r.choice(['am', 'zum', 'im', 'bitte', 'zuerst'])} {big()} der {big()} {u()} {u()} wir",
        lambda: f"{r.choice(['el', 'la', 'un', 'una', 'todo'])} {u()} {u()} {r.choice(['la', 'el', 'los', 'de', 'con', 'y el'])} {u()} {r.choice(['de', 'del', 'por', 'y', 'en'])} {u()}", lambda: f"{u()} {u()}, {u()} {u()} {r.choice(['und', 'y', 'and'])} {u()} {u()}", lambda: f"bitte {u()} {u()}", lambda: f"{u()}, {u()} {u()} {r.randint(1, 99)}",
        lambda: f"quiero {u()} las {u()} y luego {u()} la {u()}", lambda: f"{u()} {r.choice(['de', 'von', 'in', 'zu', 'a'])} {name} {u()}", lambda: f"so i {u()} and i {u()} it, {r.choice(['you', 'we', 'they'])} {u()} {u()}", lambda: f"{u()} {u()} {u()} {u()}", lambda: f"{r.choice(['der', 'die', 'das', 'den', 'el', 'la'])} {big()} {name} {u()} {r.randint(1, 999)} {big()}", lambda: f"{u()} {r.choice(['den', 'das', 'die', 'los', 'la'])} {u()} {name} {_drawn(r, 'U').title()} {u()}", lambda: f"{u()} {r.choice(['das', 'die', 'der'])} {big()} {name} {big()} {u()}", lambda: f"the {_noun(r)} for {u()} {u()} and the {_noun(r)} {u()}", lambda: f"{big()} {u()} {u()} {r.choice(['la', 'der', 'the'])} {u()}", lambda: f"{r.choice(['mit', 'con', 'von', 'por', 'und'])} {r.choice(['der', 'die', 'la', 'el', 'dem'])} {big()} {u()}",
    ])()


def _plain(r: random.Random) -> str:
    """A sentence without personal information, from a small grammar."""
    subject = r.choice([lambda: _thing(r), lambda: f"the {_noun(r)}", lambda: f"every {_noun(r)}", lambda: f"a {_noun(r)} {_noun(r)}", lambda: "we", lambda: "nobody", lambda: _thing(r)])()
    rest = r.choice([lambda: f"the {_noun(r)}", lambda: _thing(r), lambda: f"{_figure(r)} {_noun(r)}", lambda: f"{r.choice(_LISTS['code'])} {_figure(r)}", lambda: f"a {_noun(r)} at {_figure(r)}", lambda: f"a {_noun(r)} in {_drawn(r, 'U').title()}", lambda: f"it near {_thing(r)}", lambda: f"{_drawn(r, 'U').title()}, {_drawn(r, 'P').title()} and {_drawn(r, 'U').title()}", lambda: f"the {_noun(r)} at {_thing(r)}"])()
    end = r.choice([lambda: "", lambda: "", lambda: f" in {_drawn(r, 'U').title()}", lambda: f" with the {_noun(r)}", lambda: f" near {_thing(r)}", lambda: f" from {_drawn(r, 'U').title()}, {_drawn(r, 'P').title()}", lambda: f" {r.choice(['in', 'near', 'of', 'toward'])} {_drawn(r, 'U').title()} {_drawn(r, 'U').title()}", lambda: " on Monday", lambda: f" {_figure(r)}", lambda: f" for {_noun(r)} {_figure(r)}"])()
    s = f"{subject} {r.choice(VERBS)} {rest}{end}"
    s = r.choice([lambda: s, lambda: s, lambda: s, lambda: f"then {s}", lambda: f"{r.choice(_LISTS['code'])} {_figure(r)}: {s}", lambda: f"{_noun(r)} {_figure(r)} {r.choice(VERBS)} {rest}", lambda: f"{_noun(r)} {_figure(r)} is {_noun(r)}", lambda: f"{_thing(r)}: {_figure(r)}", lambda: f"at {_figure(r)} {s}", lambda: _foreign(r), lambda: _foreign(r), lambda: f"hay {r.randint(1, 99)} {_noun(r)} en la {_noun(r)} {_drawn(r, 'U').title()}", lambda: f"am Montag waren {r.randint(1, 99)} {_noun(r).title()} im {_noun(r).title()}", lambda: f"{_noun(r)} @{_word(r)}_{r.randint(1, 99)} {r.choice(VERBS)} it"])()
    return s[:1].upper() + s[1:] + r.choice([".", ".", ".", "!", "?", ""])


def invented(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sentences of the generator; a third of them with several items in one line, some in one case."""
    r = random.Random(seed)
    _fill_lists()
    make = {"person_name": _name, "email": _email, "phone": _phone, "id_number": _identity, "address": _address}
    out = []
    for _ in range(n):
        text, spans = "", []
        if r.random() < 0.25:
            mark = r.choice([" | ", "; ", " / "])
            parts = [(k, make[k](r)) for k in r.sample(TYPES, r.randint(2, 3))]
            for at, (k, item) in enumerate(parts):
                text += mark if at else ""
                spans.append((len(text), len(text) + len(item), k))
                text += item
            text += r.choice(["", " " + _plain(r)])
        else:
            for _ in range(r.randint(1, 3)):
                text += " " if text else ""
                if r.random() < 0.5:
                    text += _plain(r)
                    continue
                k = r.choice((*TYPES, "person_name"))
                first, *others = r.choice(CONTEXTS[k]).split("{}")
                text += first
                for part in others:
                    item = make[k](r)
                    spans.append((len(text), len(text) + len(item), k))
                    text += item + part
        spans = [(s, e if re.search(r" [A-Z]\.$", text[s:e]) else s + len(text[s:e].rstrip(".")), k) for s, e, k in spans]
        case = r.random()
        text = text.lower() if case < 0.3 and len(text.lower()) == len(text) else text.upper() if 0.3 <= case < 0.4 and len(text.upper()) == len(text) else text
        out.append((text, spans))
    return out


_WEIGHTS: dict = {}


def fitted_weights(sentences: int = TRAIN_SENTENCES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.5, shrink: float = 1e-4) -> dict[str, float]:
    """Weights of the features: stochastic gradient on the conditional log-likelihood (AdaGrad steps)."""
    key = (sentences, epochs, seed, rate, shrink)
    if key not in _WEIGHTS:
        data, number = [], {}
        for text, spans in invented(sentences, seed):
            found, truth = segments(text), set(spans)
            if found:
                data.append((_lattice(found), [[number.setdefault(f, len(number)) for f in s[3]] for s in found], [tuple(s[:3]) in truth for s in found]))
        weights, power = [0.0] * len(number), [1e-6] * len(number)
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(data)
            for prior, features, true in data:
                slope: dict[int, float] = {}
                for own, p, t in zip(features, _chances(prior, [sum([weights[f] for f in own]) for own in features]), true, strict=True):
                    if abs(t - p) > 1e-4:
                        for f in own:
                            slope[f] = slope.get(f, 0.0) + t - p
                for f, g in slope.items():
                    g -= shrink * weights[f]
                    power[f] += g * g
                    weights[f] += rate * g / math.sqrt(power[f])
        _WEIGHTS[key] = {f: weights[i] for f, i in number.items()}
    return _WEIGHTS[key]


# ------------------------------------------------------------------ over a table
def recogniser(docs: DataFrame, folder: str, fit: dict):
    """A function for the workers: the segments found in a text. Weights and known words are broadcast; both are bounded, by
    the features of the grammar and by the size of the vocabularies."""
    shared = docs.sparkSession.sparkContext.broadcast((fitted_weights(**fit), known_words(folder)))
    held: list[Lexicon] = []

    def find(text: str) -> list[Segment]:
        weights, words = shared.value
        if not held:
            held.append(Lexicon(*words))
        return decode(segments(text, held[0]), weights)

    return find


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, **fit) -> DataFrame:
    """Every piece of personal information of every text: doc_id, pii_type, pii_text, start, end (characters).

    Whole texts are read. Null and blank texts have none; equal pieces of one document come once for each
    place; repeated rows repeat their pieces; rows without an id are left out; an empty table gives no
    rows; other columns are dropped. Telephone and identity numbers have 7 to 16 digits in at most six groups, names up
    to three words besides initials and particles.
    """
    find = recogniser(docs, folder, fit)
    src = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf.doc_id, pdf.text, strict=True):
                out += [(i, k, t[s:e], s, e) for s, e, k, _ in find(t)]
            yield pd.DataFrame(out, columns=["doc_id", "pii_type", "pii_text", "start", "end"])

    return src.mapInPandas(search, "doc_id bigint, pii_type string, pii_text string, start int, end int")


def redact_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, **fit) -> DataFrame:
    """The texts with a typed placeholder such as [EMAIL] in place of each piece: doc_id, text, n_pii. Null texts stay null."""
    find = recogniser(docs, folder, fit)
    src = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, counts = [], []
            for t in pdf.text:
                at, parts, found = 0, [], find(t) if t else []
                for s, e, k, _ in found:
                    parts += [t[at:s], f"[{k.upper()}]"]
                    at = e
                texts.append(None if t is None else "".join(parts) + t[at:])
                counts.append(len(found))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text": texts, "n_pii": counts})

    return src.mapInPandas(clean, "doc_id bigint, text string, n_pii int")
