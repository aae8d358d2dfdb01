"""Mail: addresses, merged copies, derived access, document text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrock.model import TUPLE_COLUMNS
from quillrock.operators.deliveries import addresses, canonical_id, clean_address
from quillrock.session import persisted

# Fixed values.
MIN_GROUP_SIZE = 3
MIN_GROUP_SUPPORT = 4
SUBJECT_CHARS = 200
QUOTE_MARKERS = ("-----Original Message-----", "---------------------- Forwarded by", "----- Forwarded by", "-----Forwarded by", "\n> ")
LIST_NAMES = (
    r"all[._-].*", r".*[._-]dl", r"dl[._-].*", r".*employees.*", r".*announcements?.*", r".*distribution.*", r".*[._-]team", r"everyone", r"staff",
    r"undisclosed[._-]recipients",
)
LIST_PATTERN = f"^({'|'.join(LIST_NAMES)})$"
MESSAGES = (
    "message_id string, subject string, sender string, `to` array<string>, cc array<string>, date string, body string, mailboxes array<string>, source_paths array<string>"
)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _inside(address: Column, domain: str) -> Column:
    host = F.substring_index(address, "@", -1)
    return (host == domain) | host.endswith(f".{domain}")


def is_distribution_list(address: Column, domain: str) -> Column:
    """Whether an address of the named domain (or one under it) names a list rather than a person."""
    return F.coalesce(_inside(address, domain) & F.substring_index(address, "@", 1).rlike(f"(?i){LIST_PATTERN}"), F.lit(False))


def digest(c: Column, size: int) -> Column:
    """BLAKE2b of ``size`` bytes in hexadecimal."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=size).hexdigest())

    return run(c)


def message_object(message_id: Column, row_id: Column) -> Column:
    """``doc:`` and the digest of the identifier in its bracketed lower-case form; a message without
    identifier has the digest of its row."""
    name = F.coalesce(F.concat(F.lit("<"), canonical_id(message_id), F.lit(">")), F.concat(F.lit("row "), row_id.cast("string")))
    return F.concat(F.lit("doc:"), digest(name, 8))


def mentions(messages: DataFrame) -> DataFrame:
    """``row_id, pos, address`` of the sender (``pos`` 0) and the recipients of merged messages."""
    to = F.transform(addresses("to", "cc"), lambda a, i: F.struct((i + 1).alias("pos"), a.alias("address")))
    sender = F.struct(F.lit(0).alias("pos"), clean_address(F.col("sender")).alias("address"))
    return messages.select("row_id", F.inline(F.concat(F.array(sender), to))).where("address is not null")


def address_principals(messages: DataFrame, domain: str) -> DataFrame:
    """``address, n, is_list, base, nth, principal`` of all addresses of merged messages.

    ``group:dl_<slug>#member`` of a list, ``user:<slug>`` of an inside address, and of an outside one
    ``user:`` with its domain. Where several addresses come to one slug the first seen (by message
    and place) keeps it and the others (``nth`` > 1) get a digest of theirs, so that two people are
    never one principal; an address without a letter or digit is named by its digest.
    """
    a = F.col("address")
    local = F.substring_index(a, "@", 1)
    seen = mentions(messages).groupBy("address").agg(F.min(F.struct("row_id", "pos")).alias("first"), F.count("*").alias("n"))
    base = F.when(is_distribution_list(a, domain) | _inside(a, domain), slug(local)).otherwise(slug(F.replace(a, F.lit("@"), F.lit("-at-"))))
    seen = seen.withColumn("is_list", is_distribution_list(a, domain)).withColumn("base", base)
    same = Window.partitionBy("is_list", F.when(F.col("base") == "", a).otherwise(F.col("base"))).orderBy("first")
    seen = seen.withColumn("nth", F.row_number().over(same))
    user = F.when(F.col("base") == "", digest(a, 6)).when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), digest(a, 3)))
    principal = F.when(F.col("is_list"), F.concat(F.lit("group:dl_"), "base", F.lit("#member"))).otherwise(F.concat(F.lit("user:"), user))
    return seen.select("address", "n", "is_list", "base", "nth", principal.alias("principal"))


def merged_messages(messages: DataFrame) -> DataFrame:
    """One row per identifier: the copy with most addresses, with the mailboxes and paths of all copies
    in the order they came (``row_id``), each once. Rows without identifier all stay.

    Columns: ``row_id`` of the first copy, ``kept_row_id``, ``message_id``, ``subject``, ``sender``,
    ``to``, ``cc``, ``date``, ``body``, ``mailboxes``, ``source_paths``, ``n_copies``. The copies of
    one message are collected by their mailbox names only, each name once per partition.
    """
    key = F.coalesce(canonical_id("message_id"), F.concat(F.lit("\x00"), F.col("row_id").cast("string")))
    m = messages.withColumn("__key", key).withColumn("__n", F.size(addresses("to", "cc")))
    value = F.struct("row_id", "message_id", "subject", "sender", "to", "cc", "date", "body")
    best = m.groupBy("__key").agg(
        F.max_by(value, F.struct("__n", -F.col("row_id"))).alias("v"), F.min("row_id").alias("row_id"), F.count("*").alias("n_copies")
    )
    names = lambda c: (
        m.select("__key", "row_id", F.posexplode(c).alias("i", "x")).where("x is not null").groupBy("__key", "x").agg(F.min(F.struct("row_id", "i")).alias("at"))
        .groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(c))
    )
    out = best.join(names("mailboxes"), "__key", "left").join(names("source_paths"), "__key", "left")
    return out.select(
        "row_id", F.col("v.row_id").alias("kept_row_id"), *[F.col(f"v.{c}").alias(c) for c in ("message_id", "subject", "sender", "to", "cc", "date", "body")],
        "mailboxes", "source_paths", "n_copies",
    )


def document_text() -> Column:
    """The header lines that are there, a blank line, the body."""
    line = lambda name, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"{name}: "), c))
    listed = lambda c: F.array_join(c, ", ")
    head = F.concat_ws("\n", line("Subject", F.col("subject")), line("From", F.col("sender")), line("To", listed("to")), line("Cc", listed("cc")), line("Date", F.col("date")))
    return F.when(head == "", F.col("body")).otherwise(F.concat(head, F.lit("\n\n"), F.coalesce(F.col("body"), F.lit(""))))


def mail_documents(messages: DataFrame) -> DataFrame:
    """``row_id, object_ref, text, metadata, boundaries`` of messages: what is chunked, what stands beside
    it, and the offsets that no chunk may cross (quoted mail, the end of the header)."""
    from quillrock.operators.ingest import quote_boundaries

    @F.pandas_udf("array<int>")
    def marks(x: pd.Series) -> pd.Series:
        return x.map(lambda t: quote_boundaries(t) if t else [])

    beside = {"message_id": "message_id", "subject": F.substring(F.coalesce("subject", F.lit("")), 1, SUBJECT_CHARS), "sender": "sender", "date": "date"}
    some = F.map_filter(F.create_map(*[x for k, v in beside.items() for x in (F.lit(k), F.col(v) if isinstance(v, str) else v)]), lambda k, v: F.coalesce(F.length(v), F.lit(0)) > 0)
    d = messages.withColumn("text", document_text())
    return d.select("row_id", message_object(F.col("message_id"), F.col("row_id")).alias("object_ref"), "text", some.alias("metadata"), marks(F.col("text")).alias("boundaries"))


def sample_messages(spark: SparkSession, domain: str = "sample.example") -> DataFrame:
    """Eleven made-up messages that hold what the derivation looks for: a set of people that recurs five
    times, a wider one that holds it and recurs, mail to a list, mail that lies in several mailboxes."""
    at = lambda n: f"{n}@{domain}"
    core, wide = ["ana", "ben", "cas"], ["ana", "ben", "cas", "dov"]
    rows = [(f"core {i}", "ana", core, ["ana"] if i % 2 else ["ana", "ben"]) for i in range(5)]
    rows += [(f"wide {i}", "ana", wide, ["dov"]) for i in range(5)]
    rows += [("to all", "eve", ["all.staff"], ["ana", "ben", "eve"])]
    data = [(i + 1, f"<sample-{i}@{domain}>", subject, at(sender), [at(x) for x in to], [], f"{1 + i} Mar 2001 09:00:00 +0000", f"Body of {subject}.", boxes, [f"{b}/{i}." for b in boxes]) for i, (subject, sender, to, boxes) in enumerate(rows)]
    return spark.createDataFrame(data, f"row_id bigint, {MESSAGES}")


class Derivation:
    """What mail implies about access, over merged messages (``merged_messages``).

    The people of a message are the owners of the mailboxes that hold it, its sender and its
    recipients. A set of people that recurs becomes a group; a list becomes a group of the
    owners of mailboxes that hold mail to it. A list in the sender field grants, but no membership
    follows from it. Messages without anybody are skipped.
    """

    def __init__(self, messages: DataFrame, domain: str, min_size: int = MIN_GROUP_SIZE, min_support: int = MIN_GROUP_SUPPORT):
        self.messages, self.min_size, self.min_support = messages, min_size, min_support
        self.principals = persisted(address_principals(messages, domain), "addresses")
        named = mentions(messages).join(self.principals.select("address", "is_list", "principal"), "address")
        named = persisted(named.select("row_id", "pos", "is_list", "principal").distinct(), "mentions")
        owners = messages.select("row_id", F.explode("mailboxes").alias("m")).select("row_id", slug(F.col("m")).alias("m")).where("m <> ''")
        self.owners = owners.select("row_id", F.concat(F.lit("user:"), "m").alias("principal")).distinct()
        persons = self.owners.unionByName(named.where("not is_list").select("row_id", "principal"))
        self.people = persisted(persons.groupBy("row_id").agg(F.array_sort(F.collect_set("principal")).alias("people")), "people")
        self.lists = named.where("is_list")
        sets = self.people.where(F.size("people") >= min_size).groupBy("people").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
        self.sets = persisted(sets.select("people", "support", F.concat(F.lit("rs_"), digest(F.array_join("people", "\0"), 6)).alias("group")), "sets")
        listed = self.lists.where("pos > 0").select("row_id", F.col("principal").alias("list")).distinct()
        held = listed.join(self.owners, "row_id").groupBy("list").agg(F.array_sort(F.collect_set("principal")).alias("people"))
        of_lists = held.select(F.substring_index(F.substring_index("list", ":", -1), "#", 1).alias("group"), "people")
        self.groups = persisted(of_lists.unionByName(self.sets.select("group", "people")), "groups")
        self.nested = persisted(nested_groups(self.groups), "nested")

    def viewers(self) -> DataFrame:
        """``row_id, principal, kind`` (``list``, ``set`` or ``person``): who may view each message.

        Where the people are a group, the group is named, and the owners beside it.
        """
        matched = self.people.join(self.sets.select("people", "group"), "people", "left")
        whole = matched.where("`group` is not null")
        return (
            self.lists.select("row_id", "principal").distinct().withColumn("kind", F.lit("list"))
            .unionByName(whole.select("row_id", F.concat(F.lit("group:"), "group", F.lit("#member")).alias("principal"), F.lit("set").alias("kind")))
            .unionByName(self.owners.join(whole.select("row_id"), "row_id", "left_semi").select("row_id", "principal", F.lit("person").alias("kind")))
            .unionByName(matched.where("`group` is null").select("row_id", F.explode("people").alias("principal"), F.lit("person").alias("kind")))
        )

    def tuples(self) -> DataFrame:
        named = self.messages.select("row_id", message_object(F.col("message_id"), F.col("row_id")).alias("object"))
        as_group = F.concat(F.lit("group:"), F.col("group"))
        every = (
            self.nested.select(as_group.alias("object"), F.lit("member").alias("relation"), F.explode("rest").alias("principal"))
            .unionByName(self.nested.select(as_group.alias("object"), F.lit("member").alias("relation"), F.explode("subgroups").alias("g")).select("object", "relation", F.concat(F.lit("group:"), "g", F.lit("#member")).alias("principal")))
            .unionByName(self.viewers().join(named, "row_id").select("object", F.lit("viewer").alias("relation"), "principal"))
        )
        who = F.col("principal")
        return every.distinct().select(
            F.substring_index("object", ":", 1).alias("object_ns"), F.substring("object", F.instr("object", ":") + 1, F.length("object")).alias("object_id"), "relation",
            F.substring_index(who, ":", 1).alias("principal_ns"), F.substring_index(F.substring(who, F.instr(who, ":") + 1, F.length(who)), "#", 1).alias("principal_id"),
            F.when(who.contains("#"), F.substring_index(who, "#", -1)).otherwise("").alias("principal_rel"),
        ).select(*TUPLE_COLUMNS)

    def stats(self) -> DataFrame:
        """One row of counters."""
        v = persisted(self.viewers(), "viewers")
        one = lambda df, c, name: df.agg(c.cast("bigint").alias(name))
        parts = [
            one(self.messages, F.count("*"), "messages"), one(v, F.count_distinct("row_id"), "documents"),
            one(self.groups, F.count("*"), "groups"), one(self.groups.where("`group` like 'dl\\_%'"), F.count("*"), "groups_from_lists"), one(self.sets, F.count("*"), "groups_from_sets"),
            one(self.nested, F.coalesce(F.sum(F.size("subgroups")), F.lit(0)), "nested_edges"), one(v.where("kind <> 'person'"), F.count("*"), "grants_via_group"),
            one(v.where("kind = 'person'"), F.count("*"), "grants_direct"), one(v, F.count_distinct("principal"), "principals"),
        ]
        out = parts[0]
        for p in parts[1:]:  # one row each
            out = out.crossJoin(p)
        return out.withColumn("skipped", F.col("messages") - F.col("documents"))


def recipient_sets(messages: DataFrame, domain: str) -> DataFrame:
    """``people, support`` of the recurring sets of people."""
    return Derivation(messages, domain).sets.select("people", "support")


def nested_groups(groups: DataFrame) -> DataFrame:
    """``group, subgroups, rest``: a group directly contains the largest groups of two members or more that
    lie in what is left of it, chosen greedily by size and then id; ``rest`` are its members by
    themselves.

    Candidate pairs come from the shared first member of the smaller group, not from all pairs.
    """
    g = groups.select("group", "people")
    first = g.where(F.size("people") > 1).select(F.col("group").alias("subgroup"), F.col("people").alias("subpeople"), F.element_at("people", 1).alias("m"))
    each = g.select("group", "people", F.explode("people").alias("m"))
    inside = each.join(first, "m").where((F.size("subpeople") < F.size("people")) & (F.size(F.array_except("subpeople", "people")) == 0))
    ordered = F.array_sort(F.collect_list(F.struct((-F.size("subpeople")).alias("n"), "subgroup", "subpeople")))
    listed = inside.groupBy("group").agg(ordered.alias("subs"))
    step = lambda acc, s: F.when(
        F.size(F.array_except(s["subpeople"], acc["left"])) == 0,
        F.struct(F.array_except(acc["left"], s["subpeople"]).alias("left"), F.concat(acc["taken"], F.array(s["subgroup"])).alias("taken")),
    ).otherwise(acc)
    start = F.struct(F.col("people").alias("left"), F.array().cast("array<string>").alias("taken"))
    folded = F.aggregate(F.coalesce("subs", F.array().cast(listed.schema["subs"].dataType)), start, step)
    out = g.join(listed, "group", "left").select("group", folded.alias("f"))
    return out.select("group", F.col("f.taken").alias("subgroups"), F.col("f.left").alias("rest"))


def derived_tuples(messages: DataFrame, domain: str) -> DataFrame:
    return Derivation(messages, domain).tuples()


# --- readers


def _rfc822(raw: bytes, path: str) -> dict | None:
    msg = message_from_bytes(raw, policy=policy.compat32)
    body = None
    for part in msg.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            data = part.get_payload(decode=True) or b""
            body = data.decode(part.get_content_charset() or "utf-8", "replace")
            break
    if not body or not body.strip():
        return None
    listed = lambda h: [a.strip() for a in re.split(r",(?![^\"]*\"(?:[^\"]*\"[^\"]*\")*[^\"]*$)", msg.get(h) or "") if a.strip()]
    return {
        "message_id": (msg.get("Message-ID") or f"<{hashlib.blake2b(raw, digest_size=8).hexdigest()}>").strip(), "subject": msg.get("Subject") or "", "sender": msg.get("From") or "",
        "to": listed("To"), "cc": listed("Cc"), "date": msg.get("Date") or "", "body": body, "path": path,
    }


def read_maildir(spark: SparkSession, root: str) -> DataFrame:
    """One row per RFC 822 file under ``root``, whose top folder is the mailbox; files without a text body
    are dropped, a missing identifier is the hash of the file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, c in zip(b.path, b.content) if (r := _rfc822(bytes(c), p))], columns=["message_id", "subject", "sender", "to", "cc", "date", "body", "path"])

    rows = files.mapInPandas(run, "message_id string, subject string, sender string, `to` array<string>, cc array<string>, date string, body string, path string")
    base = root.removeprefix("file://").rstrip("/") + "/"
    inner = F.substring(F.col("path"), F.instr("path", base) + len(base), F.length("path"))
    return rows.select(*[F.col(c) for c in ("message_id", "subject", "sender", "to", "cc", "date", "body")], F.array(F.substring_index(inner, "/", 1)).alias("mailboxes"), F.array(inner).alias("source_paths"))


#: Names under which a field may stand in JSON lines, tried in order.
JSON_FIELDS = {
    "message_id": ("message_id", "Message-ID", "id"), "subject": ("subject", "Subject"), "sender": ("from", "sender", "From"), "date": ("date", "Date"),
    "body": ("body", "text", "content", "email"), "mailbox": ("user", "mailbox", "path"),
}


#: A text that begins like this is a mail with its header.
MAIL_HEAD = re.compile(r"(?i)(?:message-id|date|from|to|subject|cc|received|x-[\w-]+|mime-version|return-path):[ \t]")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON lines; blank, malformed and non-object lines are skipped. A body that is a whole
    mail is read as such; fields beside it come first. Raises if no line has any of the known body
    fields, naming the fields that were seen."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    known = sorted({n for names in JSON_FIELDS.values() for n in names})
    read = lines.select(F.from_json("value", F.lit("map<string,string>"), {"mode": "PERMISSIVE"}).alias("m")).where("m is not null")
    got = {k: F.coalesce(*[F.element_at("m", F.lit(n)) for n in names]) for k, names in JSON_FIELDS.items()}
    rows = read.select("m", *[v.alias(k) for k, v in got.items()])
    if not read.isEmpty() and rows.where("body is not null").isEmpty():
        seen = sorted(r[0] for r in read.select(F.explode(F.map_keys("m")).alias("k")).distinct().limit(50).collect())
        raise ValueError(f"no body field among {known}; seen: {seen}")
    names = ["message_id", "subject", "sender", "to", "cc", "date", "body"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for given in b.to_dict("records"):
                mail = _rfc822(given["body"].encode(), "") if MAIL_HEAD.match(given["body"]) else None
                mail = mail or {"to": [], "cc": [], "body": given["body"], "message_id": f"<{hashlib.blake2b(given['body'].encode(), digest_size=8).hexdigest()}>"}
                out.append({n: given.get(n) or mail.get(n) or "" for n in names if n not in ("to", "cc", "body")} | {n: mail[n] for n in ("to", "cc", "body")} | {"mailbox": given["mailbox"]})
            yield pd.DataFrame(out, columns=[*names, "mailbox"])

    schema = "message_id string, subject string, sender string, `to` array<string>, cc array<string>, date string, body string, mailbox string"
    read_ = rows.where("body is not null").select("message_id", "subject", "sender", "date", "body", "mailbox").mapInPandas(run, schema)
    none = F.array().cast("array<string>")
    return read_.select(*names, F.when(F.col("mailbox").isNotNull(), F.array("mailbox")).otherwise(none).alias("mailboxes"), none.alias("source_paths"))


def questions(rows: DataFrame) -> DataFrame:
    """``item_id, n, question, answer``: questions and answers zipped by position; a missing answer is
    empty, an empty question is skipped."""
    e = rows.select("item_id", F.posexplode("questions").alias("n", "question"), "answers").where(F.coalesce(F.trim("question") != "", F.lit(False)))
    return e.select("item_id", "n", "question", F.coalesce(F.try_element_at("answers", F.col("n") + 1), F.lit("")).alias("answer"))

