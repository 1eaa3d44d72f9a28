"""Variant spellings of names typed by people: noisy-channel attribution to canonical forms."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.skew import hot_cold_join
from codeweft.session import cut_lineage

#: Given names and their short forms (fixed values).
SHORT_FORMS = """
abigail abby abbie gail; alexander alex alec sasha xander sandy lex al; alexandra alex sasha sandra lexi alix; alison ali allie; andrew andy drew; anthony tony ant; barbara barb babs barbie bobbie; beatrice bea trixie trix bee;
benjamin ben benny benji; bernard bernie; bridget biddy bridie; cameron cam; caroline carrie caro; catherine cathy cate cat kate katie kit kitty kay; charles charlie chuck chas chaz; charlotte lottie charlie lotte char; christina chris tina chrissy christy;
christopher chris kit topher kris christy; cynthia cindy; daniel dan danny; deborah deb debbie debby debs; dominic dom nic nicky domi; donald don donnie; dorothy dot dottie dolly; edward ed eddie ted teddy ned eddy; eleanor ellie nell nora ella elle lena nellie;
elizabeth liz beth betty eliza lizzie libby bess lisa betsy lizzy; emily em emmy; francesca fran frankie chess franny cesca; francis frank frankie fran; frederick fred freddie fritz freddy rick; gabriel gabe gabi gab; geoffrey geoff jeff; george georgie; gerald gerry jerry;
gregory greg gregg; gwendolyn gwen wendy gwenny lyn; harold harry hal; henrietta hetty etta hattie henny hettie harriet; henry harry hank hal; ignatius iggy nate ignace; isabella izzy bella isa ibby belle; jacob jake jay; james jim jimmy jamie; janet jan; jennifer jen jenny;
jessica jess jessie; john jack johnny jon; jonathan jon jonny nathan johnny; joseph joe joey; josephine josie jo jojo posy; joshua josh; judith judy jude; katherine kate kathy katie kat kay kit; kenneth ken kenny; kimberly kim kimmy kimmie; lawrence larry; leonard leo len lenny lennie;
lucinda lucy cindy lu luce; madeline maddie; margaret meg maggie peggy marge margie greta rita peg madge daisy; matthew matt matty; maximilian max; melissa mel missy; michael mike mick micky mickey mikey; natalia nat talia natasha tally nattie natalie; nathaniel nate nat; nicholas nick nico nicky nic klaus cole;
octavia tavi tavy via octa; oliver ollie olly noll; pamela pam; patricia pat patty tricia trish patsy tish; patrick pat paddy; peter pete; philip phil pip flip; quentin quin quint quen quinn; rebecca becky becca reba bex beck; richard rick dick rich ricky richie dickie; robert rob bob bobby robbie bert bobbie;
ronald ron ronnie; samantha sam sammy; samuel sam sammy; stephen steve stevie steph ste; steven steve; susanna sue susie suzy sukie anna suzie zanna sanna; teresa tess terry tessa tracy tessie reese; theodore theo ted teddy; thomas tom tommy thom; timothy tim; ursula ulla ursa sula urs uschi;
valerie val; veronica ronnie; victoria vicky tori vic vicki tory vick; vincent vince vin vinny vinnie; virginia ginny; walter walt wally; wilhelmina mina billie willa wilma minnie willie helmi mine; william bill will billy liam willy wills; zachary zach zack zac zak; zenobia zena zen nobia zee zeno
"""
FORMAL: dict[str, list[str]] = {}
for _entry in SHORT_FORMS.split(";"):
    _names = _entry.split()
    for _short in _names[1:]:
        FORMAL.setdefault(_short, []).append(_names[0])
KNOWN_GIVEN = frozenset(x.split()[0] for x in SHORT_FORMS.split(";")) | frozenset(FORMAL)
_SHORT = {e.split()[0]: e.split()[1:] for e in SHORT_FORMS.split(";")}

#: Accounts that name no person, and mailboxes that several people share (fixed values).
GENERIC = frozenset("unknown root admin administrator ubuntu build builder jenkins runner user me your name yourname nobody anonymous none na n/a test ci bot git github gitlab system service deploy deployer ec2-user vagrant default localhost developer guest support info noreply no-reply travis docker".split()) | {"", "-", "your name", "no name", "ci user", "build user", "?", "unknown user"}
ROLE_MAILBOX = frozenset("dev info support noreply no-reply admin root build builds opensource oss it team git ci contact hello office mail me user users webmaster postmaster help security ops devops engineering developers github bot bots jenkins".split())
#: Words of organisation names: legal forms, articles, and the kinds with their abbreviations (fixed values).
LEGAL = frozenset("inc incorporated ltd limited llc gmbh ag ab oy as sa s.a. sarl bv nv plc co corp corporation company kg srl spa the and & pty aktiebolag osakeyhtio gesellschaft mit mbh beschrankter haftung aktiengesellschaft sociedad societe anonyme anonima aktieselskab besloten vennootschap naamloze".split())
KINDS = {"labs": "laboratories", "laboratory": "laboratories", "lab": "laboratories", "intl": "international", "int'l": "international", "eng": "engineering", "engg": "engineering", "fdn": "foundation", "fnd": "foundation", "found": "foundation", "ind": "industries", "inds": "industries", "sys": "systems", "system": "systems", "sw": "software", "soft": "software", "cons": "consulting", "consult": "consulting", "tech": "technologies", "technology": "technologies", "univ": "university", "assoc": "association", "grp": "group", "solns": "solutions", "svcs": "services", "mfg": "manufacturing"}
KIND_WORDS = frozenset(KINDS.values()) | frozenset(("holdings", "partners", "studio", "studios", "institute", "networks", "research"))
#: Names in scripts without blanks: two to five signs.
_UNSPACED = re.compile("[\u3400-\u9fff\uac00-\ud7af]{2,5}")
_TITLES = re.compile(r"^(?:dr|prof|mr|mrs|ms|miss|ing|sir|dipl|mx)\.?\s+", re.I)


def fold(text: str) -> str:
    """Lower case without accents; text that was decoded by the wrong encoding is decoded again."""
    for _ in range(2):
        if re.search("[ÃÂ][\x80-\xbf‘-›Œ-Ÿƒ]", text):
            for codec in ("latin-1", "cp1252"):
                try:
                    text = text.encode(codec).decode("utf-8")
                    break
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
            else:
                break
    text = unicodedata.normalize("NFKD", text).casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("ß", "ss").replace("æ", "ae")
    return "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def mail_keys(email: str | None) -> tuple[str | None, str | None, bool]:
    """``(mailbox, handle, personal)``: the address without case and tag, its local name where that names a
    person, and whether the mailbox is no shared one.  Hidden and machine addresses have a handle but no mailbox."""
    e = fold((email or "").strip())
    if "@" not in e:
        return None, None, False
    local, domain = e.rsplit("@", 1)
    local = local.split("+", 1)[1] if re.match(r"^\d+\+", local) else local.split("+", 1)[0]
    if local in ROLE_MAILBOX or not local:
        return f"{local}@{domain}", None, False
    if "noreply" in domain or domain.endswith((".local", ".localdomain", ".local.invalid")) or domain == "localhost":
        return None, local, True
    return f"{local}@{domain}", local, True


def _org(words: list[str]) -> str | None:
    """``root kind`` of an organisation, or None for a person."""
    kinds = [KINDS.get(w.strip(".,"), w.strip(".,")) for w in words]
    kind = [k for k in kinds if k in KIND_WORDS]
    legal = [w for w in words if w.strip(",") in LEGAL or w.strip(".,") in LEGAL]
    rest = [w.strip(".,") for w, k in zip(words, kinds) if k not in KIND_WORDS and w.strip(",") not in LEGAL and w.strip(".,") not in LEGAL]
    if len(rest) == 1 and len(words) >= 2 and (kind or legal) and len(rest[0]) > 3:
        return f"{rest[0]} {' '.join(sorted(set(kind)))}".strip()
    return None


def parse_author(author: str | None, email: str | None) -> dict:
    """What one row says: ``kind`` person, org, fragment or generic, the form, and the fragment's lookup keys."""
    raw = fold(author or "")
    raw = re.sub(r"\([^)]*\)|\[[^\]]*\]", lambda m: m.group(0) if "bot" in m.group(0) else " ", raw)
    raw = re.sub(r"\s+", " ", raw).strip()
    mailbox, handle, personal = mail_keys(email)
    out: dict = {"mailbox": mailbox, "handle": handle, "personal": personal, "given": None, "family": None, "form": None, "keys": [], "kind": "fragment"}
    plain = _TITLES.sub("", raw)
    if raw in GENERIC or not re.search(r"[^\W\d_]", raw):
        out["kind"] = "generic"
        out["form"] = f"G|{raw}|{fold((email or '').strip())}" if email and email.strip() else None
        return out
    if raw.endswith("[bot]") or raw.endswith("-bot"):
        out["kind"], out["form"] = "org", "O|" + raw
        return out
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", unicodedata.normalize("NFC", author or "")) if re.match(r"^[A-Z][a-z]+[A-Z][a-z]+$", (author or "").strip()) else plain
    words = re.split(r"[\s]+|(?<=\w)-(?=\w{6,})", fold(spaced).replace(" & co", " ")) if " " in spaced or "-" in plain else [plain]
    words = [w for w in words if w and w != "&"]
    org = _org(words)
    if org:
        out["kind"], out["form"] = "org", "O|" + org
        return out
    comma = re.match(r"^([^,]+),\s*(.+)$", plain)
    tokens = [t.strip(".,'\"") for t in (f"{comma.group(2)} {comma.group(1)}" if comma else plain).split()]
    dotted = plain.rstrip().endswith(".")
    tokens = [t for t in tokens if t]
    if len(tokens) >= 3:  # middle names and initials carry no weight
        tokens = [tokens[0], tokens[-1]]
    if len(tokens) == 2:
        a, b = tokens
        if len(a) > 1 and len(b) > 1:
            if not comma and a not in KNOWN_GIVEN and b in KNOWN_GIVEN:
                a, b = b, a
            out.update(kind="person", given=a, family=b, form=f"P|{a}|{b}")
        elif len(a) == 1 and len(b) > 1:
            out["given"], out["family"] = a, b
            out["keys"] = [("if", f"{a}|{b}"), ("gi", f"{b}|{a}")]
        elif len(b) == 1 and len(a) > 1:
            out["given"], out["family"] = b, a
            out["keys"] = [("gi", f"{a}|{b}"), ("if", f"{b}|{a}")]
        return out
    token = tokens[0] if tokens else ""
    token = unicodedata.normalize("NFC", token)
    if _UNSPACED.fullmatch(token):  # family name first, without a blank
        out.update(kind="person", given=token[1:], family=token[0], form=f"P|{token[1:]}|{token[0]}")
        return out
    joined = re.sub(r"[^\w]|_", "", token)
    keys = [("j", joined), ("h", token)]
    if len(joined) == 2 and not dotted:
        keys.insert(0, ("in", joined))
    if dotted or len(joined) <= 5:
        keys.append(("f", joined))
    keys.append(("g", joined))
    out["keys"] = keys
    return out


#: Log likelihoods of the channels: how often a spelling of a person comes about so.  Those of short forms and typos are the prior of
#: what ``channel_likelihoods`` finds in the data, worth PRIOR_FORMS spellings.
PRIOR_FORMS = 200
LIKELIHOOD = {"exact": 0.0, "short": math.log(0.01), "typo": math.log(0.01), "mailbox": math.log(0.2), "name": math.log(0.05), "handle": math.log(0.5), "owner": math.log(0.01)}
#: Blocks with more forms than this are dealt out over tasks.
HOT_BLOCK = 1000
#: A spelling stays on its own below this log posterior; what is left is the share of the best candidate.
LEAST_SHARE = 0.5


def _deletions(word: str) -> set[str]:
    return {word[:i] + word[i + 1:] for i in range(len(word))} | {word} if len(word) >= 4 else {word}


def channel_of(form: str, other: str) -> str | None:
    """How a form differs from another of the same person: None where it does not, else typo, short or name."""
    if form == other or form[:2] != other[:2]:
        return None if form == other else "name"
    if form[:2] == "O|":
        return "typo" if _close(form[2:], other[2:]) else "name"
    (ga, fa), (gb, fb) = form[2:].split("|"), other[2:].split("|")
    if (ga, fa) == (fb, gb):
        return None
    if ga != gb and (gb in FORMAL.get(ga, ()) or ga in FORMAL.get(gb, ()) or set(FORMAL.get(ga, ())) & set(FORMAL.get(gb, ()))):
        return "short"
    return "typo" if (ga == gb or _close(ga, gb)) and (fa == fb or _close(fa, fb)) else "name"


def channel_likelihoods(forms: DataFrame, mailboxes: DataFrame) -> dict[str, float]:
    """``LIKELIHOOD`` with the rates of short forms and typos among spellings that a personal mailbox confirms.

    Every form of a mailbox is compared with the mailbox's most frequent form (not with each other), and what the
    comparisons say is counted; three numbers come to the driver.
    """
    known = mailboxes.join(forms.select("form", "freq"), "form")
    first = known.groupBy("mailbox").agg(F.max(F.struct("freq", "form")).getField("form").alias("best"), F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"channel": [channel_of(f, g) or "exact" for f, g in zip(b["form"], b["best"])]})

    pairs = hot_cold_join(known.select("mailbox", "form"), first, ["mailbox"], "n_forms", max(known.count(), 1)).select("form", "best")
    counts = {r["channel"]: r["n"] for r in pairs.mapInPandas(judge, "channel string").groupBy("channel").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.get("exact", 0) + counts.get("short", 0) + counts.get("typo", 0)
    rate = lambda c: math.log((counts.get(c, 0) + PRIOR_FORMS * math.exp(LIKELIHOOD[c])) / (whole + PRIOR_FORMS))
    return {**LIKELIHOOD, "short": rate("short"), "typo": rate("typo")}


def _block_keys(kind: str, given: str | None, family: str | None, form: str, handles: list[str], likelihood: dict[str, float] = LIKELIHOOD) -> list[tuple[str, str, float]]:
    """``(key, role, log likelihood)`` of a form; role i enters the index, q only asks, b does both."""
    out = []
    if kind == "org":
        root, _, rest = form[2:].partition(" ")
        out += [(f"o|{d}|{rest}", "b", likelihood["typo"]) for d in _deletions(root)]
        return out
    out.append(("x|" + "|".join(sorted((given, family))), "b", likelihood["exact"]))
    names = [(given, "b", 0.0)] + [(g, "q", likelihood["short"]) for g in FORMAL.get(given, ())]
    for g, role, cost in names:
        if g != given:
            out.append(("x|" + "|".join(sorted((g, family))), role, cost))
        out += [(f"d|{g}|{d}", role, cost + likelihood["typo"]) for d in _deletions(family)]
        out += [(f"e|{d}|{family}", role, cost + likelihood["typo"]) for d in _deletions(g)]
    out += [(f"hf|{h}|{family}", "b", likelihood["handle"]) for h in handles]
    return out


def _close(a: str, b: str, limit: int = 1) -> bool:
    """Damerau-Levenshtein distance of at most ``limit`` (1 or 2)."""
    if abs(len(a) - len(b)) > limit:
        return False
    last, now = [], list(range(len(b) + 1))
    before = None
    for i, x in enumerate(a, 1):
        last, now, before = now, [i] + [0] * len(b), last
        for j, y in enumerate(b, 1):
            now[j] = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], before[j - 2] + 1)
    return now[-1] <= limit


def same_name(form: str, own_mail: bool, role: str | None, other: str, other_mail: bool, other_role: str | None) -> bool:
    """Whether a form may be a misspelling or short form of another.

    Two forms whose surnames both stand in their own addresses, yet differ, are two people; so are two
    like names of which one writes from shared mailboxes only (``role``), unless both share one.
    """
    kind, a = form.split("|", 1)
    other_kind, b = other.split("|", 1)
    if kind != other_kind:
        return False
    if kind == "O":
        (ra, _, ka), (rb, _, kb) = a.partition(" "), b.partition(" ")
        return ka == kb and (ra == rb or _close(ra, rb)) and not (own_mail and other_mail and ra != rb)
    (ga, fa), (gb, fb) = a.split("|"), b.split("|")
    if role != other_role and fa != fb:
        return False
    if (ga, fa) == (fb, gb):
        return True
    family = fa == fb or _close(fa, fb) and len(fa) > 4 and not (own_mail and other_mail)
    shorts = {ga} | set(FORMAL.get(ga, ())) | set(_SHORT.get(ga, ()))
    given = ga == gb or gb in shorts or any(g in _SHORT.get(gb, ()) for g in (ga,)) or any(_close(g, gb) and min(len(g), len(gb)) > 3 for g in shorts)
    if given and ga != gb and fa == fb and ga in _SHORT and gb in _SHORT:
        given = False  # two full names that merely look alike, such as Alexander and Alexandra
    return family and given


def _fragment_keys(given: str, family: str) -> list[tuple[str, str]]:
    """Keys under which a person is found by fragments of the name."""
    shorts = _SHORT.get(given, [])
    names = [given, *shorts, *FORMAL.get(given, ())]
    # people write the initial of their full name, hardly that of a short form
    out = [("if", f"{n[0]}|{family}") for n in FORMAL.get(given, [given])]
    out += [("gi", f"{n}|{family[0]}") for n in names] + [("g", n) for n in names]
    out += [("j", n + family) for n in names] + [("j", family + given), ("j", given[0] + family), ("j", given[:3] + family), ("j", family + given[0])]
    out += [("in", given[0] + family[0])] + [("f", family[:n]) for n in (3, 4, 5)]
    return list(dict.fromkeys(out))


def link_authors(authors: DataFrame, commits: DataFrame | None = None, rounds: int = 20) -> DataFrame:
    """``(identity_id, entity)``: every row of ``authors(identity_id, author, email)`` with the id of its person.

    1. Parse: full names and organisations give forms; what is left are fragments (initials, handles,
       single names) and generic accounts.
    2. Channel: rates of typos and short forms among spellings that a personal mailbox confirms (``channel_likelihoods``).
       Frequency prior: commits of the spelling plus its rows.  Forms ranked by (surname stands in an own
       address, given name is a known full name, frequency) are ordered; in its blocks of like spellings, handles and personal
       mailboxes a form is compared with every other form, and of those that pass ``same_name`` it is attached to that of maximum
       posterior (prior + typo, short-form or address likelihood).  Attachments lead up in rank, but for short forms, so they form
       trees; their roots are the canonical forms, that of a ring its smallest name.
    3. Fragments ask for (mailbox or handle, piece of the name), then for the piece alone; the answer of a
       key is its most frequent person with the share of the key's weight, and the best posterior wins.
       A second pass uses the addresses that the first one attributed.

    Blocks hold distinct forms, not rows, and hot ones are salted; fragments take one answer a key.  Generic accounts are
    linked by equal addresses only.  A null identity_id is left out; rows that link to nothing are their own entity.
    """
    spark = authors.sparkSession
    rows = authors.where(F.col("identity_id").isNotNull()).select("identity_id", "author", "email")
    if commits is not None:
        # nulls as strings that no name holds; a spelling that many rows share is looked up by broadcast
        spelled = lambda df: df.withColumn("__a", F.coalesce("author", F.lit("\u0001"))).withColumn("__e", F.coalesce("email", F.lit("\u0001")))
        seen = spelled(commits).groupBy("__a", "__e").agg(F.count(F.lit(1)).alias("n_commits"))
        rows = cut_lineage(spelled(rows))
        uses = rows.groupBy("__a", "__e").agg(F.count(F.lit(1)).alias("n_rows")).join(seen, ["__a", "__e"])
        rows = hot_cold_join(rows, uses, ["__a", "__e"], "n_rows", rows.count(), how="left").drop("__a", "__e", "n_rows")
    else:
        rows = rows.withColumn("n_commits", F.lit(0))
    schema = "identity_id bigint, freq bigint, kind string, given string, family string, form string, mailbox string, handle string, personal boolean, keys array<struct<k:string,v:string>>"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, author, email, n in zip(b["identity_id"], b["author"], b["email"], b["n_commits"]):
                p = parse_author(author if isinstance(author, str) else None, email if isinstance(email, str) else None)
                out.append((i, 1 + (0 if pd.isna(n) else int(n)), p["kind"], p["given"], p["family"], p["form"], p["mailbox"], p["handle"], p["personal"], [{"k": k, "v": v} for k, v in p["keys"]]))
            yield pd.DataFrame(out, columns=["identity_id", "freq", "kind", "given", "family", "form", "mailbox", "handle", "personal", "keys"])

    parsed = cut_lineage(rows.mapInPandas(parse, schema))
    n_rows = parsed.count()
    formed = parsed.where(F.col("kind").isin("person", "org"))
    name_in_mail = F.when(F.col("kind") == "person", F.coalesce(F.col("handle").contains(F.col("family")), F.lit(False))).otherwise(
        F.coalesce(F.split(F.col("mailbox"), "@")[1].contains(F.split(F.substring("form", 3, 200), " ")[0]), F.lit(False))
    )
    forms = formed.groupBy("form").agg(
        F.sum("freq").alias("freq"), F.max(name_in_mail.cast("int")).alias("own_mail"), F.first("kind").alias("kind"), F.first("given").alias("given"), F.first("family").alias("family"),
        # set where every row of the form comes from a shared mailbox
        F.when(F.count(F.when((F.col("kind") == "person") & F.col("mailbox").isNotNull() & F.col("handle").isNull(), 1)) == F.count(F.lit(1)), F.min("mailbox")).alias("role_mailbox"),
    )
    # names of mailboxes link forms of one surname; distinct, so a hot name brings one row
    handles = formed.where(F.col("handle").isNotNull() & (F.col("kind") == "person")).select("form", "family", "handle").distinct()
    mailboxes = formed.where(F.col("personal") & F.col("mailbox").isNotNull() & (F.col("kind") == "person")).select("form", "mailbox").distinct()
    root = _canonical_forms(forms, handles, mailboxes, rounds)
    people = hot_cold_join(formed.select("identity_id", "form", "freq", "mailbox", "handle", "given", "family", "kind"), root.select("form", "root").join(formed.groupBy("form").agg(F.count(F.lit(1)).alias("n")), "form"), ["form"], "n", n_rows).drop("n")
    linked = people.select("identity_id", F.col("root").alias("entity"), "mailbox", "handle", "freq")
    roots = root.groupBy("root").agg(F.sum("freq").alias("freq"))
    names = root.where(F.col("form").startswith("P|")).select("root", F.split("form", r"\|")[1].alias("given"), F.split("form", r"\|")[2].alias("family")).join(roots, "root")
    pieces = cut_lineage(_name_pieces(names))
    fragments = parsed.where(F.col("kind") == "fragment")
    for _ in range(2):
        linked = cut_lineage(linked)
        best = cut_lineage(_attribute(fragments, linked, pieces, n_rows))
        linked = linked.unionByName(best.select("identity_id", "entity", "mailbox", "handle", "freq"))
        fragments = fragments.join(best.select("identity_id"), "identity_id", "left_anti")
    alone = fragments.select("identity_id", F.concat(F.lit("R|"), F.col("identity_id").cast("string")).alias("entity"))
    generic = parsed.where(F.col("kind") == "generic").select("identity_id", F.coalesce("form", F.concat(F.lit("R|"), F.col("identity_id").cast("string"))).alias("entity"))
    return linked.select("identity_id", "entity").unionByName(alone).unionByName(generic)


def _canonical_forms(forms: DataFrame, handles: DataFrame, mailboxes: DataFrame, rounds: int) -> DataFrame:
    """``(form, freq, root)``: attachment of each form to its maximum posterior, followed to the root."""
    forms = cut_lineage(forms)
    likelihood = channel_likelihoods(forms, mailboxes)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(form, int(freq), 2 * int(own) + (given in _SHORT), box, k, role, cost) for form, freq, own, box, kind, given, family in zip(b["form"], b["freq"], b["own_mail"], b["role_mailbox"], b["kind"], b["given"], b["family"]) for k, role, cost in _block_keys(kind, given, family, form, [], likelihood)]
            yield pd.DataFrame(out, columns=["form", "freq", "own_mail", "role_mailbox", "key", "role", "cost"])

    keyed = forms.mapInPandas(keys, "form string, freq bigint, own_mail int, role_mailbox string, key string, role string, cost double")
    full_name = F.coalesce(F.col("given").isin(list(_SHORT)), F.lit(False)).cast("int")
    by_handle = handles.join(forms.select("form", "freq", "own_mail", "role_mailbox", "given"), "form").select(
        "form", "freq", (F.col("own_mail") * 2 + full_name).alias("own_mail"), "role_mailbox", F.concat_ws("|", F.lit("hf"), "handle", "family").alias("key"), F.lit("b").alias("role"), F.lit(LIKELIHOOD["handle"]).alias("cost")
    )
    by_mailbox = mailboxes.join(forms.select("form", "freq", "own_mail", "role_mailbox", "given"), "form").select(
        "form", "freq", (F.col("own_mail") * 2 + full_name).alias("own_mail"), "role_mailbox", F.concat_ws("|", F.lit("pm"), "mailbox").alias("key"), F.lit("b").alias("role"), F.lit(LIKELIHOOD["mailbox"]).alias("cost")
    )
    keyed = cut_lineage(keyed.unionByName(by_handle).unionByName(by_mailbox))
    # every form of a block is offered; a hot block is dealt out over salts, at most 1000 blocks hold so many rows
    limit = max(HOT_BLOCK, keyed.count() // 1000)
    hot = F.broadcast(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key", F.least(F.ceil(F.col("n") / limit), F.lit(64)).cast("int").alias("salts")))
    salted = keyed.join(hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    asks = salted.withColumn("salt", F.pmod(F.xxhash64("form"), F.col("salts")).cast("int")).drop("salts")
    held = salted.where(F.col("role") == "b").select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("form").alias("to"), F.col("own_mail").alias("to_mail"), F.col("role_mailbox").alias("to_mailbox"), F.col("freq").alias("to_freq"))
    # a short form goes to the full name whatever its frequency, every other form only up in rank
    short = F.col("role") == "q"
    up = F.struct(F.col("to_mail"), F.col("to_freq"), F.col("to")) > F.struct(F.col("own_mail"), F.col("freq"), F.col("form"))
    offers = asks.join(held, ["key", "salt"]).where((F.col("to") != F.col("form")) & (short | up))
    pair = ["form", "own_mail", "role_mailbox", "to", "to_mail", "to_mailbox", "to_freq"]
    offers = offers.groupBy(*pair).agg(F.max("cost").alias("cost"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = lambda x: x if isinstance(x, str) else None
            yield b[[same_name(f, m >= 2, text(r), t, n >= 2, text(q)) for f, m, r, t, n, q in zip(b["form"], b["own_mail"], b["role_mailbox"], b["to"], b["to_mail"], b["to_mailbox"])]]

    offers = offers.mapInPandas(judge, offers.schema)
    posterior = F.col("cost") + F.log(F.col("to_freq").cast("double") + 1)
    parent = offers.groupBy("form").agg(F.max(F.struct(posterior.alias("posterior"), F.col("to"))).getField("to").alias("parent"))
    tree = cut_lineage(forms.select("form", "freq").join(parent, "form", "left").withColumn("parent", F.coalesce("parent", F.col("form"))))
    # two short forms of each other would be a ring: the smaller name is the root then
    back = tree.select(F.col("form").alias("parent"), F.col("parent").alias("grand"))
    tree = tree.join(back, "parent", "left").withColumn("parent", F.when((F.col("grand") == F.col("form")) & (F.col("form") < F.col("parent")), F.col("form")).otherwise(F.col("parent"))).drop("grand")
    # a short form that leads down may close a longer ring: its smallest name is the root, kept beside the way
    tree = tree.withColumn("least", F.least("form", "parent"))
    for _ in range(rounds):  # each round doubles the length of the chains that are followed
        tree = tree.join(tree.select(F.col("form").alias("parent"), F.col("parent").alias("next"), F.col("least").alias("further")), "parent")
        tree = cut_lineage(tree.select("form", "freq", F.col("next").alias("parent"), F.least("least", "further").alias("least"), (F.col("next") != F.col("parent")).alias("moved")))
        moved = tree.where("moved").limit(1).count()
        tree = tree.drop("moved")
        if not moved:
            return tree.select("form", "freq", F.col("parent").alias("root"))
    ring = tree.select(F.col("form").alias("parent"), F.col("least").alias("root"))
    return tree.join(ring, "parent").select("form", "freq", "root")


def _name_pieces(names: DataFrame) -> DataFrame:
    """``(entity, freq, k, v)``: pieces of each person's names under which fragments may ask."""
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(r, int(f), k, v) for r, f, g, fam in zip(b["root"], b["freq"], b["given"], b["family"]) for k, v in _fragment_keys(g, fam)]
            yield pd.DataFrame(out, columns=["entity", "freq", "k", "v"])

    return names.mapInPandas(keys, "entity string, freq bigint, k string, v string").distinct()


def _attribute(fragments: DataFrame, linked: DataFrame, pieces: DataFrame, n_rows: int) -> DataFrame:
    """Fragments with their person of maximum posterior, as ``linked``."""
    mail = linked.select("entity", F.explode(F.array_compact(F.array(F.concat(F.lit("m:"), "mailbox"), F.concat(F.lit("h:"), "handle")))).alias("mail")).distinct()
    owners = mail.join(linked.groupBy("entity").agg(F.sum("freq").alias("freq")), "entity")
    # a name piece counts with an address: pieces of the people at the address
    with_mail = mail.join(pieces, "entity").select("entity", "freq", F.concat_ws("\u0001", "mail", "k", "v").alias("key"))
    alone = pieces.where(F.col("k").isin("if", "j")).select("entity", "freq", F.concat_ws("\u0001", F.lit("n"), "k", "v").alias("key"))
    by_handle = owners.where(F.col("mail").startswith("h:")).select("entity", "freq", F.concat_ws("\u0001", F.lit("n"), F.lit("h"), F.expr("substring(mail, 3)")).alias("key"))
    owner = owners.select("entity", "freq", F.concat_ws("\u0001", F.lit("o"), "mail").alias("key"))
    entries = with_mail.unionByName(alone).unionByName(by_handle).unionByName(owner)
    index = entries.groupBy("key").agg(F.max(F.struct("freq", "entity")).alias("best"), (F.max("freq") / F.sum("freq")).alias("share"), F.count(F.lit(1)).alias("n_people"))
    mails = F.array_compact(F.array(F.when(F.col("personal") | F.col("mailbox").isNotNull(), F.concat(F.lit("m:"), "mailbox")), F.concat(F.lit("h:"), "handle")))
    asked = fragments.select("identity_id", "freq", "mailbox", "handle", "personal", "keys", mails.alias("mails"))
    piece = asked.select("identity_id", "freq", "mailbox", "handle", "mails", F.explode_outer("keys").alias("p"))
    coupled = piece.select("identity_id", "freq", "mailbox", "handle", F.explode("mails").alias("m"), "p").select(
        "identity_id", "freq", "mailbox", "handle", F.concat_ws("\u0001", "m", "p.k", "p.v").alias("key"), F.lit(LIKELIHOOD["mailbox"]).alias("cost"), F.lit(0.0).alias("need"))
    bare = piece.where(F.col("p.k").isin("if", "j", "h")).select(
        "identity_id", "freq", "mailbox", "handle", F.concat_ws("\u0001", F.lit("n"), "p.k", "p.v").alias("key"), F.lit(LIKELIHOOD["name"]).alias("cost"), F.lit(LEAST_SHARE).alias("need"))
    owned = asked.where("personal").select("identity_id", "freq", "mailbox", "handle", F.explode("mails").alias("m")).select(
        "identity_id", "freq", "mailbox", "handle", F.concat_ws("\u0001", F.lit("o"), "m").alias("key"), F.lit(LIKELIHOOD["owner"]).alias("cost"), F.lit(0.9).alias("need"))
    questions = coupled.unionByName(bare).unionByName(owned)
    uses = questions.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    answers = hot_cold_join(questions, index.join(uses, "key"), ["key"], "n", 8 * n_rows).where(F.col("share") >= F.col("need"))
    posterior = F.col("cost") + F.log(F.col("share"))
    best = Window.partitionBy("identity_id").orderBy(posterior.desc(), F.col("best.entity"))
    return answers.withColumn("r", F.row_number().over(best)).where("r = 1").select("identity_id", F.col("best.entity").alias("entity"), "mailbox", "handle", "freq")


def same_entity_pairs(links: DataFrame) -> DataFrame:
    """``(identity_a, identity_b)``: every pair of rows of one entity, the smaller id first.

    The pairs are the result asked for; entities of one row pair with nothing, and a skewed
    partition is split by the adaptive join.
    """
    links = cut_lineage(links.select("identity_id", "entity"))
    a, b = links.select(F.col("identity_id").alias("identity_a"), "entity"), links.select(F.col("identity_id").alias("identity_b"), "entity")
    return a.join(b, "entity").where(F.col("identity_a") < F.col("identity_b")).select("identity_a", "identity_b")
