"""Template residue and error-page text in the values of JSON records.

Records made by one template share their fixed words and differ in its slots. Sentences are reduced to a
skeleton (slots for names, numbers and anything that looks like a placeholder or a printed default), and
sentences of one skeleton are aligned over the whole corpus. A slot that still holds a variable name, a default
or nothing is residue if other records fill it otherwise; where every record holds the very same thing, it is
the author's own wording ("compares {{ }} with <% %> tags"). Values that are nothing but placeholders or filler
are residue by themselves.

Whole pages of errors, blocks and demands for scripts are induced from what repeats: texts that stand alike but for
names and numbers in REPEATED records or more are aligned into one template, and a template is such a page if its
words speak for one. What words say is learnt from the corpus itself: known pages (fixed values) are the seeds, all
other texts the rest, and weights come from their counts. Known pages are residue at any number.

One pass over the records, in Arrow batches, yields findings, pre-aggregated skeleton counts and the texts that could
be pages; it is stored, and only these few rows are shuffled.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import stored

REPEATED = 20
MARGIN = 3.0  # log odds that a repeated template needs to be a page of an error
MAX_WORDS = 5_000  # of the seeds, checked

# What a slot of unfilled templates looks like. Names of HTML elements in <...> are none.
HTML = "a|abbr|address|article|b|blockquote|body|br|button|center|code|dd|div|dl|dt|em|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|li|link|main|meta|nav|noscript|ol|option|p|pre|q|s|script|section|select|small|span|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|u|ul|wbr"
# Between single signs that prose uses too (<, %, _) a name is short; between others a slot is of any length.
NAME = r"[A-Za-z_/][\w./ -]{0,39}|\d{1,3}"
SLOT = re.compile(
    r"\{\{\{?[^{}]*\}?\}\}|\{%-?[^{}%]*%\}|<%[=-]?[^<>%]*%>|\$\{[^{}]*\}|#\{[^{}]*\}|\{![^{}]*\}"
    rf"|\{{(?:{NAME})\}}|<<[^<>]+>>|\[\[[^\[\]]+\]\]|\*\|[^|*]+\|\*|@@[\w./ -]+@@|(?<![\d%])%(?:{NAME})%|(?<!\w)__(?:{NAME})__(?!\w)"
    rf"|\[(?:insert|enter|add|your|type) [^\[\]]+\]|\[[^\[\]: ][^\[\]:]* here\]|<(?!/?(?:{HTML})\b[^<>]*>)(?:{NAME})>"
    r"|\[object Object\]|\$undefined\b",
    re.I,
)
DEFAULT = re.compile(r"\b(?:undefined|NaN|null(?: null)?|None|nil)\b")
BLANK = re.compile(r"^(?:(?:Hi|Dear|Hello|Hey|Congrats to|Hola|Hallo|Bonjour)\s*[,.!]|,)")
# Parts that names of template variables are made of.
VARIABLES = frozenset(
    """first last full middle name firstname lastname fullname fname lname company companyname organisation organization account business brand city state country region town industry sector niche
    job title jobtitle role position contact lead prospect person people user customer client recipient sender row record item field value custom opener icebreaker topic post posts recent tier score
    followers email mail phone domain website url site date day month year merge tag snippet text subject signature employees employee count size revenue number id key data x y foo fallback default
    if else endif for endfor in end each unless""".split()
)
# The words of the usual filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
SCRIPT = r"(?:java ?script|js|scripts?|(?:client[- ]side )?scripting|cookies and java ?script)"
CODE = r"(?:not found|forbidden|gone|bad gateway|service (?:temporarily )?unavailable|internal server error|gateway time-?out|too many requests|unauthori[sz]ed|bad request|request time-?out|method not allowed|access denied|server error|payment required|error)"
SLANG = r"(?:test(?:ing)?|asdf+|qwerty|qwe|asd|foo|bar|baz|abc|xxx+|tbd|123|1234|blah|dummy|xyz|aaa+|zzz+|n0ne|sample)"
WHAT = r"(?:\w+ ){1,3}"
# Filler, error pages and demands, each for a whole sentence in lower case without tags, quotes and end marks.
WHOLE = [
    # filler
    r"lorem(?: ipsum(?: dolor(?: sit(?: amet[\w ,;.]*)?)?)?)?", r"(?:.* )?dolor sit amet\b.*", r"(?:.* )?consectetur adipiscing\b.*",
    rf"(?:(?:your|sample|dummy|example|demo|insert|add|write|enter|type)(?: your| the| a)?) {WHAT}?(?:here|goes here|placeholder|to be added|to be written|to follow|to come)(?: please)?",
    r"(?:double[- ])?click (?:here )?to (?:edit|change)\b.*", r"here you can (?:tell|write|describe|add|put|introduce)\b.*", r"start (?:editing|writing)(?: now)?", r"edit (?:this|me)\b.{0,40}", r"welcome to your new (?:page|site|blog|website)", r"just another \w+ (?:site|blog|weblog|website)", r"this is (?:a|an|your) (?:sample|example|first|dummy) (?:page|post|text|paragraph)\b.*", r"hello world",
    r"(?:description|text|content|summary|bio|headline) (?:not yet written|not written yet|coming soon|to be added|to follow|pending)\b.{0,40}", r"(?:coming soon|under construction|content coming soon|page under construction|placeholder(?: text)?|(?:sample|dummy|filler|placeholder) text)",
    rf"(?:todo|to do|to-do|tbc|tbd|tba|fixme|wip)(?:\s*[:–-]+\s*|\s+)(?:replace|write|fill|ask|add|insert|update|confirm|check|complete|put|rewrite|get)\b.*", r"(?:todo|tbc|tbd|tba|fixme)", rf"{SLANG}(?:[\s,.-]+{SLANG})+", r"(?:asdf+|qwerty|foobar|testtest|asdfasdf)",
    # error pages
    rf"(?:(?:http|error|status|code|http error|error code|http status|http/\d(?:\.\d)?)[\s:#-]*)+[45]\d\d\b[\s:|.(–-]*(?:{CODE})?\)?(?:\s*[|–-].*)?", rf"[45]\d\d[\s:|.(–-]+{CODE}\)?(?:\s*[|–(-].*|\s+webserver.*|\s+nginx.*|\s+apache.*)?", rf"(?:internal server error|bad gateway|gateway time-?out|service unavailable|server error|forbidden|unauthori[sz]ed)(?:\s*[|(–-].*)?",
    r"(?:access|permission) denied", r"acceso denegado", r"acc[eè]s refus[eé]", r"zugriff verweigert", r"(?:seite|page) (?:wurde )?nicht gefunden\b.*", r"page (?:introuvable|non trouv[eé]e)\b.*", r"p[aá]gina (?:no encontrada|niet gevonden|non trovata|n[aã]o encontrada)\b.*", r"(?:page|file|site|url|document) not found\b.{0,40}", r"erreur (?:interne du serveur|serveur|404|500)\b.*", r"interner serverfehler", r"error interno del servidor", r"fehler \d{3}\b.*",
    r"(?:whoops|oops|uh[- ]oh|sorry|we'?re sorry|ooops)\b[,!:. ].*\b(?:page|site|url|link)\b.*(?:isn'?t here|not (?:be )?found|n'?t exist|not exist|moved|unavailable|missing|gone)\b.{0,40}", r"the (?:page|url|site|resource) (?:you (?:are looking for|requested|tried to open)|requested)\b.*(?:isn'?t here|not (?:be )?found|n'?t exist|not exist|moved|unavailable|removed)\b.*",
    r"you have been rate limited\b.*", r"(?:too many requests|rate limit exceeded)\b.*", r"your ip (?:address )?has been (?:logged|blocked|banned)\b.*", r"(?:please )?contact the (?:site|website|server) (?:owner|administrator)\b.*", r"(?:permission|authenti?fication|authori[sz]ation|login) required\b.{0,40}",
    r"this is a (?:heading|paragraph|subheading|caption|button|headline)\b.{0,60}",
    r"upstream (?:connect|request) (?:error|timeout)\b.*", r"fatal error: uncaught\b.*", r"traceback \(most recent call last\).*", r"(?:parse|syntax|fatal|runtime) error: .*\bon line \d+", r"warning: \w+\(\).*", r"error (?:establishing|connecting to) (?:a |the )?database\b.*", r"(?:this )?account (?:has been )?suspended\b.*", r"(?:the )?connection to \S+ (?:timed out|was refused|refused|was reset|failed)", r"the certificate for \S+ (?:has expired|is (?:invalid|not trusted))", r"index of /\S*", r"\S+ server ip address could not be (?:resolved|found)", r"\S+ refused to connect", r"\S+ took too long to respond",
    r".{0,80}\b(?:is|are) (?:temporarily|currently) (?:down|closed|offline) for (?:scheduled )?maintenance\b.*", r".{0,80}\b(?:is|are) (?:temporarily|currently) unavailable,? please (?:check|come|try) (?:back|again)\b.*", r".{0,80}\b(?:is|are) offline while we (?:upgrade|update|move|fix)\b.*", r".{0,80}\b(?:is|are) unable to handle (?:your|this) request\b.*", r"your session (?:on \S+ )?has (?:expired|timed out)", r"(?:your|the) request (?:was|has been) blocked", r"you have been blocked\b.*", r"sorry, you have been blocked\b.*",
    r"checking (?:your|if the site connection|the) (?:browser|is secure)\b.*", r"(?:one more step: )?(?:please )?complete the (?:captcha|security check)\b.*", r"(?:please )?verify (?:that )?you are (?:a )?human\b.*", r"are you a (?:robot|human)", r"this (?:domain )?name may be for sale", r"(?:this|the) domain \S* ?(?:is (?:parked|for sale)|has expired)\b.*", r"\S+ is parked\b.*", r"this (?:page|site|website|content) (?:can'?t be reached|isn'?t working|isn'?t available|is not available|cannot be displayed)\b.*", r"bitte versuchen sie es sp[aä]ter (?:erneut|noch einmal)", r"(?:please )?try again (?:later|in a few minutes)", r"service (?:momentan[eé]ment )?indisponible\b.*", r"servicio no disponible\b.*", r"dienst (?:nicht|derzeit nicht) verf[uü]gbar\b.*", r"reference #[\da-f.]+", r"volver al inicio", r"zur[uü]ck zur startseite", r"retour [aà] l'accueil", r"back to home(?:page)?",
    # demands for scripts
    rf"(?:please |you need to |you must |you have to |kindly )?(?:enable|activate|turn on|switch on|allow|re-?enable) {SCRIPT}\b.*", rf"{SCRIPT} (?:is|are|must be|needs to be|seems to be|appears to be) (?:required|disabled|enabled|switched (?:off|on)|not (?:available|enabled|supported)|turned (?:off|on)|needed|blocked|off|deactivated)\b.*", rf"{SCRIPT} (?:required|needed|disabled)", rf"(?:your|this) browser (?:does not|doesn'?t|can'?t|cannot) (?:support|run|execute) {SCRIPT}\b.*", rf"this (?:application|app|site|page|website|content) (?:works best with|requires|needs|depends on) {SCRIPT}\b.*", rf"some features (?:won'?t|will not|may not) work\b.*",
    r"(?:bitte )?aktivieren sie (?:bitte )?java ?script\b.*", r"java ?script (?:ist|muss|wird) .*(?:aktivier|deaktivier|ben[oö]tigt).*", r"(?:veuillez |merci d')?activer java ?script\b.*", r"java ?script (?:est|doit) .*(?:d[eé]sactiv|activ).*", r"(?:por favor,? )?(?:active|habilite|activa) java ?script\b.*", r"java ?script (?:est[aá]|debe) .*(?:desactiv|activ|habilit).*",
]
PAGE = re.compile("(?:" + "|".join(WHOLE) + ")", re.S)


def seed_words(patterns: list[str]) -> frozenset[str]:
    """The words that the seeds are written with."""
    text = re.sub(r"\[(.)[^\]]*\]", r"\1", " ".join(patterns).replace("(?:", "("))
    return frozenset(re.findall(r"[^\W\d_]{2,}", re.sub(r"\\.", " ", text).replace("?", "")))


SEEDS = seed_words([*WHOLE, SCRIPT, CODE]) - {"ing", "ed", "re"}
assert len(SEEDS) <= MAX_WORDS
WORD = re.compile(r"[^\W\d_]{2,}")
# Words by which a page speaks to its reader or of itself; texts about others have none of them.
ADDRESS = frozenset("you your please we our us this sorry bitte sie wir ihre diese vous votre veuillez nous cette usted su por favor esta".split())
# No slot is without one of these characters.
MARKED = re.compile(r"[{}<>\[\]@$|%]|__")
GREETED = re.compile(r"(?:^|\b(?:hi|dear|hello|hey|to|what|noticed|said|of|from|by|at|for|with|met|that|before|rivals of)\s+)$", re.I)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
TAGS = re.compile(rf"</?(?:{HTML})\b[^<>]{{0,200}}>", re.I)
CAPITAL = re.compile(r"\b[^\W\d_a-z]\w*(?:[ '’-][^\W\d_a-z]\w*)*|\d[\d.,:]*")
MISSING = frozenset(("", "-", "n/a", "none", "na", "null", "nan", "nil"))


def leaves(value: object) -> Iterator[str]:
    """All texts in a JSON value, without recursion limits."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, list):
            stack.extend(v)
        elif isinstance(v, dict):
            stack.extend(v.values())


def skeleton(sentence: str) -> str:
    """The fixed words of a sentence in lower case, its slots as a mark; neighbouring slots are one."""
    s = DEFAULT.sub("¤", SLOT.sub("¤", sentence))
    s = CAPITAL.sub("¤", s)
    s = re.sub(r"¤(?:[\s,]*¤)*", "¤", s)
    return re.sub(r"\s+", " ", s).strip(" .!?").lower()


def template(sentence: str, slotted: bool = True) -> int:
    """The hash of a sentence's skeleton. slotted: it may hold placeholders or defaults; else only names and numbers vary."""
    if slotted:
        fixed = skeleton(sentence)
    else:
        fixed = re.sub(r"¤(?:[\s,]*¤)*", "¤", CAPITAL.sub("¤", sentence)).strip(" .!?").lower()
        if "  " in fixed or "\t" in fixed or "\n" in fixed:
            fixed = re.sub(r"\s+", " ", fixed)
    return xxhash.xxh3_64_intdigest(fixed) - (1 << 63)


def known(slot: str) -> bool:
    """Whether a slot's content is made of usual names of variables, or is a number or the word value in slashes."""
    parts = [p for p in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", re.sub(r"(?i)^\[(?:insert|enter|add|your|type) | here\]$", "", slot)) if p]
    if not parts:
        return any(c.isdigit() for c in slot)
    return all(p.lower() in VARIABLES for p in parts)


def plain(sentence: str) -> str:
    """A sentence as the fixed pages are written: no tags, quotes and end marks, lower case."""
    s = sentence.replace("’", "'")
    if "&" in s:
        s = html.unescape(s)
    if "<" in s:
        s = TAGS.sub(" ", s)
    return re.sub(r"\s+", " ", s).strip(" \t\"'“”«».!…?").lower()


@lru_cache(maxsize=1 << 16)
def filler_word(word: str) -> bool:
    """Whether a single word of letters, in lower case, is filler or a page by itself. Remembered, as such values repeat."""
    return word == "undefined" or PAGE.fullmatch(word) is not None


def latin(sentence: str) -> bool:
    """Whether a sentence of four words or more is made of filler words, in whatever order."""
    words = re.findall(r"[a-z]+", sentence)
    return len(words) > 3 and sum(w in LOREM for w in words) >= 0.8 * len(words) and sum(len(w) > 3 and w in LOREM for w in words) > 2


def examine(text: str) -> tuple[bool, list[tuple[int, int, str, bool]]]:
    """(surely residue, in-text slots as (template, place, filler, known name))."""
    body = text.strip()
    inner = body.strip("\"'“” \t\r\n")
    if inner.lower() in MISSING or inner.isdigit():
        return False, []
    if re.match(r"=[A-Z]{2,}\(", inner):
        return True, []
    if "<noscript" in inner.lower() and re.search(SCRIPT, TAGS.sub(" ", inner), re.I):
        return True, []
    marked = bool(MARKED.search(inner))
    if " " not in inner and inner.isalpha():
        return filler_word(inner.lower()), []
    whole = plain(inner)
    if PAGE.fullmatch(whole) or whole in ("undefined", "$undefined"):
        return True, []
    if " " not in inner and not marked:
        return False, []
    slots = []
    for s in SENTENCE.split(body):
        if not s:
            continue
        whole = plain(s)
        if PAGE.fullmatch(whole) or latin(whole):
            return True, []
        found = [m.group() for m in SLOT.finditer(s)] if marked else []
        if found and sum(len(w) for w in re.findall(r"[^\W\d_]+", TAGS.sub(" ", SLOT.sub(" ", s)))) <= 8 and s.strip() == body:
            return True, []  # nothing but placeholders
        for i, f in enumerate(found):
            slots.append((template(s), i, f, known(f) or f.lower() in ("[object object]", "$undefined")))
        for m in DEFAULT.finditer(SLOT.sub(lambda x: " " * len(x.group()), s) if found else s):
            if re.match(r"\s+(?:of|and void|hypothesis|value|check|pointer|the less)\b", s[m.end() :]):
                continue
            sure = bool(GREETED.search(s[: m.start()])) and (m.group() != "None" or bool(re.match(r"\s*,", s[m.end() :])))
            slots.append((template(s), 0, m.group(), sure))
        if BLANK.match(s):
            slots.append((template(re.sub(r"^((?:Hi|Dear|Hello|Hey|Congrats to|Hola|Hallo|Bonjour)?)\s*([,.!])", r"\1 {x}\2", s)), 0, "", True))
    return False, slots


def page_template(text: str) -> str:
    """A whole text without what differs between its copies: numbers, addresses and anything with digits."""
    return re.sub(r"\s+", " ", re.sub(r"\S*\d\S*|\S+@\S+|https?://\S+", "¤", plain(text)))


def word_weights(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """The counts with what no count tells: the numbers of words in all."""
    total = {k: sum(n for (c, _), n in counts.items() if c == k) + 0.5 * (len(SEEDS) + 1) for k in ("page", "rest")}
    return {**{k: float(n) for k, n in counts.items()}, ("page", ""): total["page"], ("rest", ""): total["rest"]}


def page_odds(template: str, copies: int, counts: dict[tuple[str, str], float]) -> float:
    """Log odds, by naive Bayes over words, that a template is a page of an error. Its own copies do not count against it."""
    odds = 0.0
    for w, n in Counter(w if w in SEEDS else "*" for w in WORD.findall(template)).items():
        page, rest = counts.get(("page", w), 0.0) + 0.5, max(0.0, counts.get(("rest", w), 0.0) - copies * n) + 0.5
        odds += n * (log(page / counts["page", ""]) - log(rest / counts["rest", ""]))
    return odds


def examined(records: DataFrame, key: str, data: str) -> DataFrame:
    """The pass over the records, as rows of several kinds:

    sure: person_id, field_key of an entry that is residue by itself; slot: an entry's slot in a template's place and
    its filler; fill: a template and how many sentences fill its slots properly; text: an entry whose value could be
    a page, filler being its template; word: filler is a word, template 1 for pages and 0 for other texts, n its count.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, normal, words, seen = [], Counter(), Counter(), set()
            for rid, text in zip(pdf["id"].tolist(), pdf["data"].tolist()):
                try:
                    record = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                for field, value in record.items():
                    sure, slots = False, []
                    for leaf in leaves(value):
                        hit, more = examine(leaf)
                        sure = sure or hit
                        slots += more
                        if " " not in leaf:
                            continue
                        if not hit and not more:
                            normal.update(SENTENCE.split(leaf))
                        mine = WORD.findall(leaf.lower())
                        telling = sum(map(SEEDS.__contains__, mine))
                        if not telling:
                            continue
                        new = leaf not in seen
                        if new:
                            seen.add(leaf)
                            words.update((hit, w if w in SEEDS else "*") for w in mine)
                        if not hit and telling > 2 and 3 * telling > len(mine) and not ADDRESS.isdisjoint(mine):
                            rows.append((rid, field, "text", None, None, page_template(leaf), None, int(new)))
                    if sure:
                        rows.append((rid, field, "sure", None, None, None, True, 1))
                    else:
                        rows += [(rid, field, "slot", t, i, f, k, 1) for t, i, f, k in dict.fromkeys(slots)]
            keys: Counter = Counter()
            for s, n in normal.items():
                keys[template(s, False)] += n
            rows += [(None, None, "fill", t, None, None, None, n) for t, n in keys.items()]
            rows += [(None, None, "word", int(hit), None, w, None, n) for (hit, w), n in words.items()]
            yield pd.DataFrame(rows, columns=["person_id", "field_key", "what", "template", "place", "filler", "known", "n"]).astype({"template": "Int64", "place": "Int64"})

    # The key keeps its own type; null keys stay null and are found like any other.
    src = records.select(F.col(key).cast("string").alias("id"), F.make_valid_utf8(data).alias("data")).where("data IS NOT NULL AND data <> ''")
    return src.mapInPandas(read, "person_id string, field_key string, what string, template bigint, place int, filler string, known boolean, n bigint")


def repeated_pages(out: DataFrame) -> DataFrame:
    """filler: the repeated templates that are pages of errors. out: see examined."""
    rows = out.where("what = 'word'").groupBy("template", "filler").agg(F.sum("n").alias("n")).limit(2 * MAX_WORDS).collect()  # two classes of the seeds' words
    held = out.sparkSession.sparkContext.broadcast(word_weights({("page" if r["template"] else "rest", r["filler"]): r["n"] for r in rows}))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[page_odds(t, n, held.value) > MARGIN for t, n in zip(pdf["filler"], pdf["n"])]][["filler"]]

    # Of equal copies in one batch the words were counted once: n.
    often = out.where("what = 'text'").groupBy("filler").agg(F.count("*").alias("copies"), F.sum("n").alias("n")).where(f"copies >= {REPEATED}")
    return often.mapInPandas(judge, "filler string")


def find_residue(records: DataFrame, key: str = "id", data: str = "custom_data") -> DataFrame:
    """person_id, field_key, how of every entry that holds template residue or error-page text in place of content.

    how is 'aligned' where other records or copies show it, 'known' where it is recognised by itself. Null, empty and
    unreadable records, and values that are no objects, have no entries; of keys given twice in a record the last
    counts; an entry counts once however many of its parts are residue. Repeated rows come out once; extra columns
    are not read.
    """
    out = stored(examined(records, key, data), "examined")
    # Alignment: what the slots of a template hold in all its records. Sentences without slots fill them properly.
    filled = out.where("what IN ('slot', 'fill')").groupBy("template", "place").agg(F.sum("n").alias("n"), F.min("filler").alias("least"), F.max("filler").alias("most"))
    filled = filled.groupBy("template").agg(
        F.max(F.col("place").isNull()).alias("normal"), F.collect_list(F.when(F.col("least") != F.col("most"), F.col("place"))).alias("varied")
    ).where("normal OR size(varied) > 0")
    slots = out.where("what = 'slot'").join(filled, "template", "left")
    aligned = F.expr("coalesce(normal OR array_contains(varied, place), false)")
    slots = slots.where(aligned | F.col("known")).select("person_id", "field_key", aligned.alias("aligned"))
    pages = out.where("what = 'text'").join(repeated_pages(out), "filler").select("person_id", "field_key", F.lit(True).alias("aligned"))
    found = out.where("what = 'sure'").select("person_id", "field_key", F.lit(False).alias("aligned")).unionByName(slots).unionByName(pages)
    return found.groupBy("person_id", "field_key").agg(F.when(F.max("aligned"), "aligned").otherwise("known").alias("how"))
