"""Units of a text, and what can be trusted to be template residue, filler or an error page by its form alone.

A unit is a line (a title, a field value, a paragraph, a list item) without its marks. Two kinds of evidence count: a
*place* of a template inside of a unit, found after quoted, back-ticked and code parts are taken out, and the form of a
unit as a whole: filler, a stand-in, an error object or an empty page. Messages are a short table of seeds; the units of
a corpus meet them, and one another, as equal or near forms.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import regex

# Field words that stand in places of templates in several languages.
_ASK = (
    r"insert|enter|your|todo|tbd|fill(?:ed)? in|to be (?:filled|completed|added|written|defined|decided)|placeholder|goes here|describe|brief|type here|add here|replace"
    r"|hier|einfügen|eintragen|einsetzen|platzhalter|ausfüllen|ergänzen|kurzbeschreibung|name des|name der|noch offen|folgt"
    r"|à compléter|compléter|insérer|votre|texte ici|à remplir|à venir|à définir|ici"
    r"|insertar|completar|rellenar|aquí|escriba|pendiente|nombre corto|por definir|su texto"
    r"|wpisz|uzupełni\w*|wstaw|tutaj|krótka nazwa|do uzupełnienia|do wpisania"
    r"|ここに|入力|未記入|記入|記載|未定|後日|プレースホルダ\w*|仮置き"
)
_FIELD = r"(?:actor|owner|title|summary|rationale|statement|threshold|stakeholder|acceptance[ _]criterion|component(?:[ _]name)?|requirement(?:[ _]id)?|review[ _]date|name|date|author|description|version|project|company|customer)"
_MARKUP = regex.compile(r"<(?:html|head|body|h[1-6]|p|div|span|br|hr|b|i|u|em|strong|a|ul|ol|li|table|t[rdh]|thead|tbody|img|code|pre|script|noscript|style|meta|link|form|input|button|details|kbd|sup|sub)(?:\s[^<>]*)?/?>")

#: unfilled or unrendered places that count in prose and in code alike
_PLACES = regex.compile(
    r"\{\{\{?[#/^>!]?[^{}\n]{0,80}\}?\}\}"
    r"|\{%-?\s*[^%\n]{1,80}%\}|<%[=\-#]?[^%\n]{1,80}%>"
    r"|@@\s*\w[\w. ]{0,40}@@"
    r"|(?<![\w])__(?!(?:DEV|TEST|PROD|VERSION|FILE|LINE|DIR|ENV|BUILD)__)[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)"
    r"|[\[［](?!\[)\s*(?:[^\[\]［］\n]{0,40}\s)?(?:" + _ASK + r")(?![\p{L}])[^\[\]［］\n]{0,50}[\]］](?!\()"
    r"|[\[［][^\[\]［］\n]{0,20}(?:ここに|入力|未記入|記入|未定)[^\[\]［］\n]{0,20}[\]］]"
    r"|<(?:describe|brief|insert|enter|your|name des|name der|kurzbeschreibung|insérer|votre|nombre|insertar|completar|krótka|wpisz|ここに)(?![\p{L}])[^<>\n]{0,60}>"
    r"|&lt;[^&<>\n]{2,60}&gt;"
    r"|[Cc]lick (?:or tap )?here to (?:enter|add|type|insert)\b[^.\n]{0,40}",
)
_PLACES_ANY_CASE = regex.compile(
    r"[\[［](?!\[)\s*(?:[^\[\]［］\n]{0,40}\s)?(?:" + _ASK + r")(?![\p{L}])[^\[\]［］\n]{0,50}[\]］](?!\()"
    r"|<(?:describe|brief|insert|enter|your|name des|name der|kurzbeschreibung|insérer|votre|nombre corto|insertar|completar|krótka nazwa|wpisz)(?![\p{L}])[^<>\n]{0,60}>"
    r"|[(（]\s*(?:to be (?:filled in|completed|added|written|defined|decided|confirmed)|texte à venir|à compléter|pendiente de rellenar|por completar|do uzupełnienia|noch auszufüllen|wird ergänzt|wird nachgereicht|folgt|未記入|未定|後日記入)[^()（）\n]{0,60}[)）]",
    regex.IGNORECASE,
)
#: places that mean something else in code
_PROSE_PLACES = regex.compile(
    r"[$#]\{[^{}\n]{1,60}\}|\$\([A-Za-z_][\w.]{1,40}\)"
    r"|(?<![\w$#{%])\{\s*(?!@)(?:[A-Za-z_]\w*(?:[._]\w+)*|\d{1,2})\s*\}(?!\})"
    r"|(?<![\w%])%[A-Za-z][A-Za-z_.]{2,}%(?!\w)"
    r"|(?<![\w$])\$[A-Z][A-Z_]{2,}\$(?!\w)"
    r"|(?<![\w_])_{4,}(?![\w_])|＿{3,}|…{3,}"
    r"|\[\[\s*(?:[A-Z][A-Z_ ]+[A-Z]|[a-z]+(?:[A-Z]\w*)+|" + _FIELD + r")\s*\]\]"
    r"|<<\s*[^<>\n]{2,60}>>"
    r"|(?<![\w<|])<(?![|/!=\-])[\p{L}][^<>|=/,;(){}\n]{1,60}>(?!>)"
    r"|(?<!\p{L})\?{3,}|？{2,}|○{2,}|●{3,}|◯{2,}"
    r"|\b[A-Z]{2,}-X{2,}(?:-[NX]{2,})?\b|(?<![\w-])X{3,}(?![\w-])"
)
_PROSE_MARKS = re.compile(r"[$#{%<?？○●◯＿]|__|…{3}|\[\[(?!REQ-|docs/)|XX")
_PLACE_MARKS = re.compile(r"\[(?!\[)|［|<[%A-Za-zÀ-žａ-ｚこ]|&lt;|@@|__[A-Z]|\{\{|\{%|lick (?:or tap )?here|[(（](?=[^()]{0,8}(?:to be|à v|à c|text|pend|por|do u|noch|wird|folg|未|後))", re.IGNORECASE)
#: characters without which neither can match
_PLACE_CHARS, _PROSE_CHARS = frozenset("[［<&@_{(（"), frozenset("$#{%<?？○●◯＿_…[X")
_CODE_PLACES = regex.compile(r"\[\[\s*[A-Za-z]\w*\s*\]\]|<<\s*\w[\w ]*>>|(?<![\w$])\$[A-Z][A-Z_]{2,}\$|(?<![\w%])%[A-Z][A-Z_]{2,}%|[$#]\{[A-Za-z][\w.]*\}")
_MENTION_BEFORE = regex.compile(r"\b(?:to be|is|are|was|were|be|called|says?|said|marked|word|mark|reads?|as|means|like|write|writes)\s*$", regex.IGNORECASE)
_OPEN_WORDS = regex.compile(r"(?<![\w-])(?:TBD|TBC|TBA)(?![\w-])|\[object Object\]")

_FENCE = regex.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n[\s\S]*?(?:^[ \t]*\1[^\n]*$|\Z)", regex.MULTILINE)
_TICKS = regex.compile(r"(`+)[^`]+?\1")
_QUOTED = regex.compile(r'"[^"\n]{1,200}"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»|「[^」\n]{1,200}」|『[^』\n]{1,200}』')
_QUOTES = re.compile('["“„«「『]')
_LITERAL = regex.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')
_USAGE = regex.compile(r"\b(?:[Uu]sage|[Ss]yntax|[Aa]ufruf|[Uu]so)\s*:[^.\n]*")
_CODE_LINE = regex.compile(r"^\s*(?:import\b.*\bfrom\b|export\s+(?:class|function|const|async|default|interface|abstract|type|enum)\b|(?:async\s+)?function\b|(?:const|let|var)\s+\w+|class\s+\w+|(?:public|private|protected)\s+\w+)", regex.MULTILINE)
_COMMENT = regex.compile(r"^\s*(?:/\*+|\*+/?|//+)\s?|\s*\*+/\s*$")
_DIGIT = re.compile(r"\d")
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{4,}")
_LINES = regex.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
_COMMENT_LINE = regex.compile(r"\s*(?:/\*|\*|//)")
_END_NOTE = regex.compile(r"(?<!:)//\s*(?:TODO|FIXME|XXX|HACK)\b")
_CODE_NAME = regex.compile(r"(?<=\b(?:class|function|const|let|interface|type|new|extends)\s+)(?:[$#]\{\w[\w.]*\}|\$[A-Z_]{3,}\$|%[A-Z_]{3,}%|<<?\w+>>?|\[\[\w+\]\])")
_ODD_LETTERS = regex.compile(r"[bcdfghjklmnpqrstvwxz]{3}")
_WORK_NOTE = regex.compile(r"^(?:TODO|FIXME|XXX|HACK|NOTE)\b|^todo\s*:", regex.IGNORECASE)
_LIST_MARK = regex.compile(r"^[\s>#]*(?:[-*+•·◦]\s+|\d{1,3}[.)]\s+|\[[ xX]\]\s+)*[\s#>]*")
_LABEL = regex.compile(r"^(?:---)?:?\s*[\p{L}][\p{L}\p{N} _-]{0,30}:\s+|^---:\s*")
_TAG = regex.compile(r"</?[A-Za-z][^<>\n]*>")

# Stand-ins that mark missing content when they are all of a unit.
_EMPTY_UNITS = frozenset(
    "tbd|tba|tbc|t.b.d.|todo|fixme|undefined|null|nan|placeholder|platzhalter|lorem|xxx|xx|???|??|…|...|n.n.|[object object]|coming soon|to be defined|to be done|to be determined"
    "|to be added|to be written|to be decided|work in progress|under construction|insert text here|your text here".split("|")
)

# Words of the usual Latin filler text.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo "
    "consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum mauris faucibus "
    "tristique pellentesque vivamus integer nec odio praesent libero cursus ante dapibus diam semper porta massa".split()
)
#: keys that fingers rest on, and some beside them
_KEYS = frozenset("asdfjklqwer")
_FOO = frozenset("foo bar baz qux text sample test xxx blah bla lorem dummy placeholder word words example content asdf qwerty テスト ダミー サンプル beispiel texto texte tekst".split())

# Trusted seeds, whole units that are error messages, notices that scripts are required, or filler. They
# are not searched for in texts: units that are equal or near to them are linked to them. 0 stands for any name.
SEEDS = """
Not Found
Page not found
Bad Request
Access denied
Unauthorized
Internal Server Error
Bad Gateway
Service Unavailable
Service Temporarily Unavailable
Gateway Time-out
Request Timeout
Too many requests. Try again later.
Error establishing a database connection
Oops! Something went wrong.
Something went wrong.
Whoops, looks like this link is broken.
Sorry, we couldn't find that page.
The page you requested could not be found.
The page you are looking for does not exist.
The document you asked for no longer exists.
This page isn't working right now.
We are down for maintenance.
You do not have permission to view this resource.
Your session has expired. Please sign in again.
Application error: an exception occurred while loading the page.
The requested URL 0 was not found on this server.
Seite nicht gefunden
Interner Serverfehler
Zugriff verweigert
Der Dienst ist zurzeit nicht verfügbar
Der Dienst ist derzeit nicht verfügbar
Der Dienst ist vorübergehend nicht verfügbar
Der Dienst ist zurzeit nicht verfügbar. Bitte versuchen Sie es später noch einmal.
Der Dienst ist derzeit nicht verfügbar. Bitte versuchen Sie es später noch einmal.
Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später noch einmal.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Page introuvable
Erreur interne du serveur
Accès refusé
Le service est momentanément indisponible
Votre session a expiré, veuillez vous reconnecter.
Página no encontrada
Error interno del servidor
Acceso denegado
El servicio no está disponible en este momento
Su sesión ha caducado. Vuelva a iniciar sesión.
Nie znaleziono strony
Wewnętrzny błąd serwera
Brak dostępu
Usługa jest chwilowo niedostępna
Sesja wygasła. Zaloguj się ponownie.
ページが見つかりません
アクセスが拒否されました
サーバー内部エラーが発生しました
現在サービスをご利用いただけません
セッションの有効期限が切れました。再度ログインしてください。
You need to enable JavaScript to run this app.
Please enable JavaScript to continue.
Please enable JavaScript.
JavaScript is disabled in your browser. Turn it on and reload.
JavaScript is required.
Please turn on scripts and cookies to view this 0.
Scripts are blocked. Allow them for this site to see the 0.
Checking your browser before you can go on. Scripts must be allowed.
We're sorry but this 0 doesn't work properly without JS enabled.
We're sorry but 0 doesn't work properly without JavaScript enabled.
This 0 requires JavaScript.
Your browser does not support scripts, or they are switched off.
noscript: the 0 cannot start without JavaScript
The 0 cannot start without JavaScript.
Bitte aktivieren Sie JavaScript, um diese Anwendung zu nutzen.
Diese Seite benötigt JavaScript.
JavaScript est requis pour afficher ce contenu.
Veuillez activer JavaScript pour continuer.
Active JavaScript en su navegador para continuar.
Esta página necesita JavaScript para mostrarse.
Włącz obsługę JavaScript, aby zobaczyć tę stronę.
Ta strona wymaga JavaScript.
このページを表示するには JavaScript を有効にしてください。
Sample text goes here. Replace it with your own content.
Your text here.
Copy to come.
Text to come.
This is placeholder content; nothing to see yet.
Dummy paragraph to fill the space until the real words arrive.
Type something. This block only shows how a paragraph would look.
Content coming soon.
Dies ist ein Blindtext. Er steht hier nur, damit die Seite nicht leer ist.
Hier steht später der Text.
Texte de remplissage, à remplacer par le contenu définitif.
Texto de relleno. Sustituir por el contenido definitivo.
Texto de relleno, sustituir por el contenido definitivo.
Tekst zastępczy, do podmiany przed publikacją.
これはダミーテキストです。公開前に差し替えてください。
""".strip().split("\n")

_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}"
_WORDS = regex.compile(rf"[{_CJK}]|(?:(?![{_CJK}])[\p{{L}}\p{{N}}\p{{M}}])+(?:['’](?:(?![{_CJK}])[\p{{L}}])+)*")


# Furniture of served pages that stands around messages and is no message by itself.
_FURNITURE = regex.compile(
    r"\bRequest ID:?\s*#?[0-9a-f]+\b|\bReference\s*#[0-9a-f]+\b|\bcode=\d+\s+path=\S+|\bat \w+ \([^()\s]+:\d+:\d+\)|(?<![\w/])[\w-]+/\d+(?:\.\d+)+(?![\w/])|©\s*\d{4}\s*\S+"
    r"|\bBack \| Home \| Help\b|\bReturn to the home page\b|\bTry reloading in a few minutes\b\.?|\bPlease contact your administrator\b\.?|\bAn unexpected condition was met\b\.?"
    r"|\bSkip to content\b|\bMenu\s+Search\s+Sign in\b|\bLoading\s*(?:\.{3}|…)|\bPlease wait\b(?:\s*(?:\.{3}|…))?",
    regex.IGNORECASE,
)
#: a line (in lower case) without any of these has no furniture
_FURNITURE_MARKS = ("request id", "reference", "code=", ".js:", ".ts:", "©", "back |", "home page", "reloading", "administrator", "unexpected", "skip to", "sign in", "loading", "please wait")
_SERVER = re.compile(r"/\d+\.")
_URL_NOTICE = "the requested url was not found on this server"
_STATUS = regex.compile(r"^\s*(?:HTTP(?:/\d(?:\.\d)?)?\s*(?:Status|Error)?\s*)?(?:Error\s*)?[45]\d\d(?!\d)\s*[:–—-]?\s+", regex.IGNORECASE)
_STATUS_HEAD = re.compile(r"\s*(?:[45]\d\d|HTTP|Err|Fehler|Błąd|エラー)", re.IGNORECASE)
_STATUS_ALONE = regex.compile(r"^\s*(?:HTTP(?:/\d(?:\.\d)?)?\s*(?:Status|Error)?|Error|Fehler|Erreur|Błąd|エラー)\s*[45]\d\d\s*[.!]?\s*$", regex.IGNORECASE)
_ERROR_JSON = regex.compile(r'^\{\s*"(?:error|message|status|code)"\s*:.*\}\s*$')
_JSON_TEXT = regex.compile(r'"(?:error|message)"\s*:\s*"((?:[^"\\]|\\.)*)"')
_JSON_FAULT = regex.compile(r'"(?:status|code)"\s*:\s*"?[45]\d\d|"error"\s*:')
#: what ends a sentence or stands between parts of a line
_BREAKS = (". ", "! ", "? ", "… ", "。", " - ", " – ", " — ", " | ")
#: names in notices about scripts: any one word stands in their place
_NAMED = regex.compile(r"(?<=\brequested url )\S+(?: \S+)*?(?= was not found)|(?<=\bsorry but )\S+(?: \S+)?(?= doesn't)|(?<=\b(?:this|the) )\S+(?= (?:requires javascript|cannot start without|doesn't work properly))|(?<=\b(?:to view this|to see the) )\S+$")
_NAME_MARKS = re.compile(r"requested url|requires javascript|cannot start|doesn't work|view this|see the")
_SPACES = re.compile(r" {2,}")
_ODD_MARKS = re.compile(r"_|<\||0x|@v|[-=]>")
_ODD_TOKEN = regex.compile(r"(?<!\S)(?:0x[0-9A-Fa-f]+|@v\d\S*|[-=]>)(?!\S)|<\|[^<>|\s]*\|>|(?<!\S)\S*_\S*(?!\S)|[\p{Cf}\p{Cc}]+|(?<![\p{L}\p{N}])[^\p{Han}\p{Hiragana}\p{Katakana}\x00-\x7f©…。–—](?![\p{L}\p{N}])")

_ASCII_WORDS = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z]+)*")


def words_of(text: str) -> list[str]:
    """Words of a text; every Chinese or Japanese character is one."""
    return _ASCII_WORDS.findall(text) if text.isascii() else _WORDS.findall(text)



def is_code_text(text: str, source: str | None = None) -> bool:
    return source == "source-code" or len(_CODE_LINE.findall(text)) >= 2 or bool(_CODE_LINE.match(text))


def is_filler(words: list[str]) -> bool:
    """Latin filler, one or two words over and over, or strokes on neighbouring keys; ``words`` in lower case."""
    if len(words) < 2:
        return False
    distinct = set(words)
    if len(distinct & _LATIN) >= 2:
        latin = sum(w in _LATIN for w in words)
        if latin >= 4 and latin * 10 >= len(words) * 6 or words[:2] == ["lorem", "ipsum"] and latin * 2 >= len(words):
            return True
    if len(words) < 4:
        return False
    if len(distinct) * 2 <= len(words) + 4:
        counts = Counter(words).most_common(2)
        word, most = counts[0]
        if most >= 4 and most * 10 >= len(words) * 8 and not word.isdigit() and len(word) > 1:
            return True
        if sum(n for w, n in counts if w in _FOO) * 10 >= len(words) * 8:
            return True
    if sum(_KEYS.issuperset(w) for w in words[:8]) < 3:
        return False
    strokes = [w for w in words if len(w) >= 3 and _KEYS.issuperset(w)]
    odd = sum(bool(_ODD_LETTERS.search(w)) for w in strokes)
    return len(strokes) >= 4 and len(strokes) * 10 >= len(words) * 7 and odd * 2 >= len(strokes)


def message_form(unit: str) -> tuple[str, bool]:
    """The normal form of a unit without the furniture of served pages, and whether its form alone says that it is an error.

    Sentences that are told twice count once, names and odd tokens are masked. An error by form is a JSON object with an
    error or status, a status without more, or a page that has nothing but one heading and furniture.
    """
    text, told, page = unit, False, False
    if unit[0] == "{" and _ERROR_JSON.match(unit):
        text = "\x00".join(_JSON_TEXT.findall(unit))
        told = bool(text) and bool(_JSON_FAULT.search(unit))
    elif "<" in unit and _TAG.search(unit):
        page = unit[:6].lower() in ("<html>", "<html ", "<!doct")
        text = _TAG.sub("\x00", unit)
    furniture = 0
    if not text.isascii() or _ODD_MARKS.search(text):
        text = _SPACES.sub(" ", _ODD_TOKEN.sub(lambda m: "\x00" if m.group() == "\x00" else " ", text))
    low = text.lower()
    if "/" in low and _SERVER.search(low) or any([mark in low for mark in _FURNITURE_MARKS]):
        text, furniture = _FURNITURE.subn("\x00", text)
    if "requested URL" in text:
        text = text.replace("The requested URL", "\x00The requested URL")
    parts: list[str] = []
    for mark in _BREAKS:
        text = text.replace(mark, "\x00")
    for part in text.split("\x00"):
        if not part or part.isspace():
            continue
        if _STATUS_HEAD.match(part) is None:
            pass
        elif (status := _STATUS.match(part)) and status.end() < len(part):
            part = part[status.end() :]
            furniture += 1
        elif _STATUS_ALONE.match(part):
            told = True
        form = _bare(words_of(part.lower()))
        if (" js" in form or "javascript" in form or " url " in form or "scripts" in form or " to see the " in form) and _NAME_MARKS.search(form):
            form = " ".join(_NAMED.sub("", form).split())
        if form and form not in parts:
            parts.append(form)
    if len(parts) > 1 and _URL_NOTICE in parts:
        parts.remove(_URL_NOTICE)
    return " ".join(parts), told and len(parts) <= 2 or page and furniture > 0 and len(parts) == 1


def _bare(words: list[str]) -> str:
    """Words without numbers, where at least two others are left; Latin text without single words of another script."""
    text = " ".join(words)
    if text.isascii() and not _DIGIT.search(text):
        return text
    kept = [w for w in words if not w[0].isdigit()]
    if len(kept) < 2:
        kept = words
    latin = [w for w in kept if w[0] < "\u0250"]
    if len(latin) >= 3 and len(kept) - len(latin) <= 4:
        kept = latin
    return normal_words(kept)


def places_in(unit: str, code: bool) -> list[str]:
    """The unfilled places of a unit from which code, quotes and usage lines were taken out."""
    found = []
    if not (_PLACE_CHARS.isdisjoint(unit) and "lick" not in unit) and _PLACE_MARKS.search(unit):
        found = [m.group() for m in _PLACES.finditer(unit)] + [m.group() for m in _PLACES_ANY_CASE.finditer(unit)]
    if code:
        return found
    for m in _PROSE_PLACES.finditer(unit) if not _PROSE_CHARS.isdisjoint(unit) and _PROSE_MARKS.search(unit) else ():
        if m.group()[0] == "<" and m.group()[1] != "<" and ("</" in unit or _MARKUP.fullmatch(m.group())):
            continue
        found.append(m.group())
    for m in _OPEN_WORDS.finditer(unit) if "TB" in unit or "[object" in unit else ():
        if not _MENTION_BEFORE.search(unit[: m.start()]):
            found.append(m.group())
    return found


#: form, unfilled places, whether the unit is residue as a whole by its form
Unit = tuple[str, tuple[str, ...], bool]


def units_of(text: str, source: str | None = None) -> list[Unit]:
    """Every unit of a text."""
    code = is_code_text(text, source)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if not code and "`" in text:
        text = _TICKS.sub(" \x01 ", text)
    out: list[Unit] = []
    for line in _LINES.split(text):
        if line and not line.isspace():
            out += _known_line(line, code) if len(line) <= KEPT_LINE else _line_units(line, code)
    return out


def _line_units(line: str, code: bool) -> tuple[Unit, ...]:
    comment = code and bool(_COMMENT_LINE.match(line))
    if code:
        bare = _COMMENT.sub("", _COMMENT.sub("", line)) if comment else line
        if comment and _WORK_NOTE.match(bare.strip()):
            return ((message_form(bare)[0], (), False),)
        clean = _TICKS.sub(" \x01 ", bare) if comment else _LITERAL.sub('""', bare)
        note = _END_NOTE.search(clean)
        clean = clean[: note.start()] if note else clean
    else:
        clean = line
    unit = _LIST_MARK.sub("", clean).strip()
    if not unit:
        return ()
    label = None if code else _LABEL.match(unit)
    value = unit[label.end() :].strip() if label else unit
    if code and not comment and "'" in line and '"' not in line and "`" not in line:
        unit = value = _LIST_MARK.sub("", line).strip()  # a message with apostrophes, or a line of code that is none
    forms = []
    for part in [unit] if value is unit or not value else [unit, value]:  # the value of a field is a unit of its own
        low = part.lower().strip(" .:;!*_") if part.lower() not in _EMPTY_UNITS else part.lower()
        form, whole = message_form(part)
        if code and (not comment and " " not in form or low in ("todo", "fixme", "undefined", "null")):
            form = "code: " + form  # a word of the language, no copy of a stand-in
        elif part.lower() in _EMPTY_UNITS or low in _EMPTY_UNITS:
            whole = whole or not code or comment
        whole = whole or is_filler(form.split(" "))
        if not form and whole:  # marks only, as a row of question marks
            form = "place: " + part
        forms.append((form, (), whole))
    spoken = _USAGE.sub(" ", unit) if ":" in unit else unit
    if (not code or comment) and _QUOTES.search(spoken):
        spoken = _QUOTED.sub(" \x01 ", spoken) if len(_QUOTED.sub("", spoken).strip()) > 2 else spoken
    places = places_in(spoken, code)
    if code and not places and comment:
        places = [m.group() for m in _CODE_PLACES.finditer(spoken)]
    elif code and not places:
        places = [m.group() for m in _CODE_NAME.finditer(spoken)]
    forms[0] = (forms[0][0], tuple(places), forms[0][2])
    return tuple(f for f in forms if f[0] or f[1])


#: lines come again from text to text, so a worker keeps what it made of them; longer ones are not kept
KEPT_LINE = 300
_known_line = functools.lru_cache(maxsize=100_000)(_line_units)


def normal_words(words: list[str]) -> str:
    """Words in lower case as one text, numbers and long hexadecimal ids as 0."""
    text = " ".join(words)
    if not _DIGIT.search(text):
        return text
    return " ".join(w if w.isalpha() else "0" if w[0].isdigit() or _HEX.fullmatch(w) else w for w in words)


def normal_form(unit: str) -> str:
    return normal_words(words_of(unit.lower()))
