"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "[ \\t\\r\\n\\f]+"


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), WHITE), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def normalised_tag(tag: Column) -> Column:
    """Trimmed, lower-case, runs of separators as one hyphen, no hyphen at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), r"[\s_/\\-]+", "-"), "^-+|-+$", "")


def normalised_tags(tags: Column) -> Column:
    """Distinct normalised tags in order, without empty ones."""
    return F.array_distinct(F.filter(F.transform(tags, normalised_tag), lambda x: x != ""))


#: Latin letters with marks and their base letters (fixed values).
MARKED, BASE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def slug(title: Column, most: int = 64) -> Column:
    """Lower-case ASCII words joined by hyphens, ``most`` characters at most."""
    plain = F.regexp_replace(F.translate(F.lower(title), MARKED, BASE), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, most), "-+$", "")


def thread_slug(at: Column, thread: Column, subject: Column) -> Column:
    """Date, the thread's last six characters, and the subject's slug."""
    return F.concat_ws("-", F.date_format(at, "yyyy-MM-dd"), F.substring(thread, -6, 6), slug(subject))


def plain_text(html: Column) -> Column:
    """HTML without style and script blocks and tags, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normalised_url(url: Column, most: int = 2048) -> Column:
    """Scheme and host lower-case, no user, default port, query, fragment or path parameters; null unless http(s) or if too long."""
    parts = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:@]+)(?::(\d+))?(/[^?#]*)?(?:[?#].*)?$"
    get = lambda k: F.regexp_extract(url, parts, k)
    scheme, port = F.lower(get(1)), get(3)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(get(4), ";[^/]*", "")
    out = F.concat(scheme, F.lit("://"), F.lower(get(2)), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path))
    return F.when((get(1) != "") & (F.length(url) <= most), out)


def action_items(text: Column) -> Column:
    """``done, item`` of each list line with a checkbox, in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[-*] \[[ xX]\] "))
    return F.transform(lines, lambda x: F.struct((F.regexp_extract(x, r"\[(.)\]", 1) != " ").alias("done"), F.regexp_extract(x, r"^\s*[-*] \[[ xX]\] (.*)$", 1).alias("item")))


def wiki_links(text: Column) -> Column:
    """``embed, target, heading, alias`` of each ``[[target#heading|alias]]`` link."""
    found = F.regexp_extract_all(text, F.lit(r"(!?\[\[[^\[\]\n]+\]\])"), 1)
    inner = r"^!?\[\[([^#|\]]*)(?:#([^|\]]*))?(?:\|([^\]]*))?\]\]$"
    part = lambda x, k: F.trim(F.regexp_extract(x, inner, k))
    return F.transform(found, lambda x: F.struct(x.startswith("!").alias("embed"), part(x, 1).alias("target"), part(x, 2).alias("heading"), part(x, 3).alias("alias")))


def sub_tokens(text: Column) -> Column:
    """Distinct parts of e-mail addresses and host names in order, two characters or more."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://[^\s/?#]+)"), 1)
    parts = F.flatten(F.transform(found, lambda x: F.split(F.lower(F.regexp_replace(x, "^https?://", "")), r"[@._%+:-]+")))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.isin("www", "com", "org", "net", "http", "https")))


def folded_digits(text: Column) -> Column:
    """Full-width and Arabic-Indic digits as ASCII."""
    return F.translate(text, "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def card_numbers(text: Column) -> Column:
    """Runs of 13 to 19 digits that pass the Luhn check."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"((?<!\d)\d{13,19}(?!\d))"), 1), lambda x: F.call_function("luhn_check", x))


def one_line(text: Column) -> Column:
    """Control and format characters as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " "), r"\s+", " "))


def without_escapes(text: Column) -> Column:
    """No terminal escape sequences and no bidirectional controls."""
    return F.regexp_replace(F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", ""), "[‪-‮⁦-⁩‎‏]", "")


def is_minified(text: Column) -> Column:
    """The longest line over 1,000 characters and 200 characters a line on average."""
    lines = F.split(text, "\n")
    return (F.array_max(F.transform(lines, F.length)) > 1000) & (F.length(text) / F.size(lines) > 200)


def snowflake_time(post: Column, now: Column) -> Column:
    """Time in an id's upper bits; null for small ids and for times after ``now``."""
    offset = F.shiftright(post, 22)
    at = F.timestamp_millis(offset + F.lit(1288834974657))
    return F.when((offset >= 60_000) & (at <= now), at)


def canonical_key(name: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "")


def query_key(query: Column) -> Column:
    """Sorted distinct lower-case words without punctuation."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(F.regexp_replace(query, r"[^\p{L}\p{N}\s]+", " ")))), " ")


def person_name(name: Column) -> Column:
    """Without a trailing "via ..." and bracketed organisation; "Last, First" turned round."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\s+via\s+.*$", ""), r"\s*\([^)]*\)\s*$", ""))
    return F.when(bare.rlike(r"^[^,]+,\s*[^,]+$"), F.trim(F.regexp_replace(bare, r"^([^,]+),\s*([^,]+)$", "$2 $1"))).otherwise(bare)


#: Marks of automated senders (fixed values); a hyphen stands for any one separator or none.
AUTOMATED = ("no-reply", "do-not-reply", "donot-reply", "mailer-daemon", "postmaster", "bounce", "bounces", "notification", "notifications", "newsletter", "alerts", "automated", "automailer", "bot")


def is_automated(sender: Column, denied: tuple[str, ...] = ()) -> Column:
    """Whether a mark stands between other signs than letters in the address, or the address is denied."""
    address = F.lower(F.trim(sender))
    marked = address.rlike(r"(^|[^a-z])(" + "|".join(AUTOMATED).replace("-", "[-_.]?") + r")([^a-z]|$)")
    return marked | address.isin(*[d.lower() for d in denied]) if denied else marked


def duration_seconds(text: Column) -> Column:
    """Seconds of texts such as ``7d``, ``12h``, ``30m``, ``2w``; null otherwise."""
    unit = F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)\s*([smhdw])$", 2)
    each = reduce(lambda a, x: F.when(unit == x[0], x[1]).otherwise(a), (("s", 1), ("m", 60), ("h", 3600), ("d", 86400), ("w", 604800)), F.lit(None).cast("long"))
    return each * F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)", 1).cast("long")


# Public secret formats: name and pattern (fixed values).
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    "password": r"password=[A-Za-z0-9]{8,}",
}


def secret_findings(text: Column) -> Column:
    """``kind, line, preview`` of each line's findings; the preview shows four characters."""
    lines = F.split(text, "\n")

    def of(kind: str, pattern: str) -> Column:
        per_line = F.transform(lines, lambda x, k: F.transform(F.regexp_extract_all(x, F.lit(f"({pattern})"), 1), lambda m: F.struct(F.lit(kind).alias("kind"), (k + 1).alias("line"), F.concat(F.substring(m, 1, 4), F.lit("***")).alias("preview"))))
        return F.flatten(per_line)

    return F.flatten(F.array(*[of(k, p) for k, p in SECRETS.items()]))


def without_secrets(text: Column) -> Column:
    """Each finding replaced by its kind in brackets."""
    return reduce(lambda t, x: F.regexp_replace(t, x[1], f"[{x[0]}]"), SECRETS.items(), text)


def markdown(html: Column) -> Column:
    """HTML as Markdown: headings, list items, links with safe schemes, emphasis, quotes, code and table rows; other tags go."""
    steps = (
        (r"(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", ""),
        (r"(?s)<!--.*?-->", ""),
        *((rf"(?is)<h{k}[^>]*>\s*(.*?)\s*</h{k}>", "\n\n" + "#" * k + " $1\n\n") for k in range(1, 7)),
        (r"(?is)<a\s[^>]*href=[\"'](https?://[^\"']*|mailto:[^\"']*|/[^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)"),
        (r"(?is)<(b|strong)>(.*?)</(b|strong)>", "**$2**"),
        (r"(?is)<(i|em)>(.*?)</(i|em)>", "*$2*"),
        (r"(?is)<code>(.*?)</code>", "`$1`"),
        (r"(?is)<blockquote[^>]*>\s*(.*?)\s*</blockquote>", "\n\n> $1\n\n"),
        (r"(?is)<li[^>]*>\s*", "\n- "),
        (r"(?is)</t[dh]>\s*<t[dh][^>]*>", " | "),
        (r"(?is)<tr[^>]*>|</tr>", "\n"),
        (r"(?is)<br[^>]*>", "\n"),
        (r"(?is)</?(p|div|ul|ol|table|article|section|nav|footer|header)[^>]*>", "\n\n"),
        (r"(?s)<[^>]+>", ""),
        (r"[ \t]+", " "),
        (r" ?\n ?", "\n"),
        (r"\n\n+", "\n\n"),
    )
    return F.trim(reduce(lambda t, x: F.regexp_replace(t, x[0], x[1]), steps, html), F.lit(" \n"))


def code_skip_reason(path: Column, extensions: tuple[str, ...]) -> Column:
    """Why a repository's file is left out (vendored, lockfile, minified, extension); null for a kept one."""
    name, low = F.substring_index(path, "/", -1), F.lower(path)
    return (
        F.when(F.concat(F.lit("/"), low).rlike("/(node_modules|vendor|third_party|dist|build|\\.git)/"), "vendored")
        .when(F.lower(name).rlike(r"(^|[-.])lock(\.|$)|-lock\.(json|yaml)$"), "lockfile")
        .when(F.lower(name).rlike(r"\.(min\.[a-z]+|map)$"), "minified")
        .when(~F.lower(name).rlike(r"\.(" + "|".join(extensions) + ")$"), "extension")
    )


def week_bounds(week: Column) -> tuple[Column, Column]:
    """First and last second of an ISO week ``YYYY-Www`` in UTC."""
    year, number = F.substring(week, 1, 4).cast("int"), F.substring(week, 7, 2).cast("int")
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)).cast("timestamp"))  # the week of 4 January is the first
    start = F.timestamp_micros(F.unix_micros(first) + (number - 1) * 7 * 86_400_000_000)
    return start, F.timestamp_micros(F.unix_micros(start) + 7 * 86_400_000_000 - 1_000_000)


def sent_at(text: Column) -> Column:
    """Time of an RFC 2822 or ISO date text; without a zone it is UTC; null if it is neither."""
    bare = F.regexp_replace(F.trim(text), r"\s*\([^)]*\)$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\b(GMT|UTC?|Z)$", "+0000"), r"^[A-Za-z]{3},\s*", "")
    mail = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(mail, F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.trim(text)))


def speakers(body: Column) -> Column:
    """Distinct speakers of transcript lines ``**name | mm:ss**``, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\*\*([^*|\n]+?) *\| *\d{1,2}:\d{2}(?::\d{2})?\*\*"), 1), F.trim))


def participant(token: Column) -> Column:
    """Key of a participant: the address in it, else the lower-case name; null for placeholders such as "Speaker 2"."""
    low = F.lower(F.trim(token))
    mail = F.regexp_extract(low, r"([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})", 1)
    name = F.regexp_replace(low, r"\s+", " ")
    return F.when(mail != "", mail).when((name != "") & ~name.rlike(r"^(speaker|unknown|participant)( ?\d+)?$"), name)


def owner_keys(key: Column) -> Column:
    """The keys that name an owner: itself, an address's local part, and the first word of either."""
    low = F.lower(F.trim(key))
    local = F.substring_index(low, "@", 1)
    return F.array_distinct(F.filter(F.array(low, local, F.element_at(F.split(local, r"[ ._+-]+"), 1)), lambda x: x != ""))


def without_boilerplate(body: Column) -> Column:
    """A mail's text without its signature, footers and quoted header, and with repeated long lines once."""
    out = F.regexp_replace(body, r"(?s)\n-- ?\n.*$", "")
    out = F.regexp_replace(out, r"(?im)^(sent from my [^\n]*|unsubscribe[^\n]*|view (this email )?in (your )?browser[^\n]*|this (e-?mail|message) (and any attachments )?(is|are|may be) confidential[^\n]*)$", "")
    lines = F.split(out, "\n")
    once = F.filter(F.transform(lines, lambda x, k: F.when((F.length(x) < 40) | (F.array_position(lines, x) == k + 1), x)), lambda x: x.isNotNull())
    return F.trim(F.regexp_replace(F.array_join(once, "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def cited(text: Column, count: Column) -> Column:
    """Numbers of ``[N]`` citations in order of first appearance, from 1 to ``count``."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,6})\]"), 1), lambda x: x.cast("int")), lambda n: (n >= 1) & (n <= count)))


def truncated(text: Column, budget: int) -> Column:
    """The longest beginning whose token estimate fits; null without room for one token."""
    return F.substring(text, 1, 4 * budget + 3) if budget >= 1 else F.lit(None).cast("string")


def code_chunks(code: Column, most_lines: int = 60) -> Column:
    """``first_line, code`` pieces that begin at top-level definitions, long ones cut every ``most_lines`` lines."""
    lines = F.split(code, "\n")
    starts = r"^(async +def|def|class|function|export|func|fn|pub|impl|struct|interface|public|private|static|type) "
    places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: (k == 0) | F.get(lines, k).rlike(starts))
    ends = F.concat(F.slice(places, 2, F.size(places)), F.array(F.size(lines)))
    runs = F.arrays_zip(places.alias("a"), ends.alias("b"))
    cut = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["a"], F.greatest(r["a"], r["b"] - 1), F.lit(most_lines)), lambda k: F.struct(k.alias("a"), F.least(k + most_lines, r["b"]).alias("b")))))
    return F.transform(cut, lambda c: F.struct((c["a"] + 1).alias("first_line"), F.array_join(F.slice(lines, c["a"] + 1, c["b"] - c["a"]), "\n").alias("code")))


def basis(title: Column, summary: Column, text: Column, most: int = 512) -> Column:
    """What stands for a document in a vector: its title and summary, else its title and the head of the text, in ``most`` tokens."""
    return truncated(F.concat_ws("\n", title, F.coalesce(summary, F.substring(text, 1, 4 * most))), most)


#: Words of questions about themes rather than names (fixed values).
THEMATIC = ("themes", "topics", "overview", "overall", "trends", "summarise", "summarize", "main ideas", "big picture")


def retrieval_mode(query: str, persons: tuple[str, ...] = ()) -> tuple[str, str | None]:
    """``themes`` for a person that a query names, ``global`` for a thematic question, else ``local``; with the longest person's name."""
    words = f" {' '.join(''.join(c if c.isalnum() else ' ' for c in query.lower()).split())} "
    named = sorted((p for p in persons if f" {p.lower()} " in words), key=lambda p: (-len(p), p))
    thematic = any(f" {w} " in words for w in THEMATIC)
    return ("themes" if named and thematic else "local" if named or not thematic else "global"), (named[0] if named else None)


def clean_paraphrases(raw: list[str], original: str, most: int = 2, longest: int = 512) -> list[str]:
    """Distinct paraphrases without the original, case aside, trimmed, ``most`` at most."""
    seen, out = {original.strip().casefold()}, []
    for text in (x.strip()[:longest] for x in raw):
        if text and text.casefold() not in seen:
            seen.add(text.casefold())
            out.append(text)
    return out[:most]
