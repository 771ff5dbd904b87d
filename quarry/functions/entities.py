"""Column functions over tasks, notes and rules: dates, efforts, priorities, tags, links, checklists, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds, weights, aliases and the words of contexts.
TASK_TYPES = ("epic", "story", "task", "subtask", "milestone", "bug", "spike", "chore")
TASK_STATUSES = ("todo", "in_progress", "blocked", "done", "cancelled")
PRIORITIES = {"critical": 4, "high": 3, "medium": 2, "low": 1}
DEPENDENCY_TYPES = ("blocks", "related", "follows")
RULE_TYPES = ("pattern", "constraint", "semantic", "automation")
MERGES = ("append", "replace", "merge")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rb": "ruby", "golang": "go"}
NOTE_TYPES = ("note", "warning", "documentation", "excalidraw")
LINKED_TYPES = ("component", "file", "project", "relationship", "directory")
DIAGRAMS = "flowchart|graph|sequenceDiagram|classDiagram|stateDiagram|erDiagram|journey|gantt|gitGraph|pie"
# End of fixed values.


def language_name(lang: Column) -> Column:
    """The language that an alias or an extension stands for, in lower case."""
    low = F.lower(F.coalesce(lang, F.lit("")))
    out = low
    for alias, name in LANGUAGES.items():
        out = F.when(low == alias, name).otherwise(out)
    return out


def priority_weight(priority: Column) -> Column:
    """4 critical to 1 low; unknown and null as medium."""
    out = F.lit(2)
    for name, weight in PRIORITIES.items():
        out = F.when(priority == name, weight).otherwise(out)
    return out


def days_since(then: Column, now: Column) -> Column:
    """Days between two timestamps, with their fraction; null where one is."""
    return F.timestamp_diff("SECOND", then, now) / F.lit(86_400.0)


def cutoff(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL {days} DAYS")


def is_overdue(due: Column, status: Column, now: Column) -> Column:
    return F.coalesce(due < now, F.lit(False)) & ~F.coalesce(status.isin("done", "cancelled"), F.lit(False))


def effort_hours(effort: Column) -> Column:
    """Hours of 3h, 2d (of 8 hours) or 1w (of 40); 0 for anything else."""
    amount = F.regexp_extract(effort, r"^(\d+)[hdw]$", 1)
    unit = F.regexp_extract(effort, r"^\d+([hdw])$", 1)
    return F.when(F.coalesce(amount, F.lit("")) == "", 0).otherwise(F.try_to_number(amount, F.lit("999999999")).cast("long") * F.when(unit == "h", 1).when(unit == "d", 8).otherwise(40))


def effort_text(hours: Column) -> Column:
    """Hours under 8, whole days under 40, else whole weeks; halves round up."""
    days, weeks = F.floor(hours / 8 + 0.5).cast("string"), F.floor(hours / 40 + 0.5).cast("string")
    return F.when(hours < 8, F.concat(hours.cast("string"), F.lit("h"))).when(hours < 40, F.concat(days, F.lit("d"))).otherwise(F.concat(weeks, F.lit("w")))


def completion(done: Column, children: Column, own_done: Column) -> Column:
    """Percent of the children that are done; without children 100 or 0 by the task itself."""
    return F.when(children > 0, F.floor(100 * done / children + 0.5).cast("long")).otherwise(F.when(own_done, 100).otherwise(0))


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])), F.lit(False))


def every_tag(tags: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), tags)) == 0, F.lit(False))


def has_link(links: Column, type_: str | None = None, id_: str | None = None) -> Column:
    """Whether one link (struct type, id) matches both what is asked; nulls match nothing."""
    return F.coalesce(F.exists(links, lambda x: (F.lit(True) if type_ is None else x["type"] == type_) & (F.lit(True) if id_ is None else x["id"] == id_)), F.lit(False))


def linked(links: Column, type_: Column, id_: Column) -> Column:
    """The links with one more, unless it is there."""
    new = F.struct(type_.alias("type"), id_.alias("id"))
    there = F.exists(links, lambda x: (x["type"] == type_) & (x["id"] == id_))
    return F.when(links.isNull(), F.array(new)).when(there, links).otherwise(F.concat(links, F.array(new)))


def unlinked(links: Column, type_: Column, id_: Column) -> Column:
    return F.filter(links, lambda x: ~((x["type"] == type_) & (x["id"] == id_)))


def item_toggled(items: Column, place: Column | None = None, text: Column | None = None) -> Column:
    """A checklist (structs text, done) with one item's mark turned: by place (from 0) or by text."""
    hit = lambda x, k: (k == place) if place is not None else (x["text"] == text)
    return F.transform(items, lambda x, k: F.struct(x["text"].alias("text"), F.when(hit(x, k), ~x["done"]).otherwise(x["done"]).alias("done")))


def item_added(items: Column, text: Column, place: int | None = None) -> Column:
    new = F.struct(text.alias("text"), F.lit(False).alias("done"))
    if place is None:
        return F.concat(items, F.array(new))
    return F.concat(F.slice(items, 1, place), F.array(new), F.slice(items, place + 1, F.greatest(F.size(items) - place, F.lit(0))))


def item_removed(items: Column, place: int) -> Column:
    return F.filter(items, lambda _, k: k != place)


def item_moved(items: Column, place: int, to: int) -> Column:
    """A checklist with one item at another place; places beyond the list leave it."""
    rest = F.filter(items, lambda _, k: k != place)
    moved = F.concat(F.slice(rest, 1, to), F.slice(items, place + 1, 1), F.slice(rest, to + 1, F.greatest(F.size(rest) - to, F.lit(0))))
    return F.when((F.size(items) > place) & (F.size(items) > to), moved).otherwise(items)


def item_texts(items: Column, done: bool) -> Column:
    return F.transform(F.filter(items, lambda x: x["done"] == done), lambda x: x["text"])


def merged_maps(old: Column, new: Column) -> Column:
    """A map of both; values of the new one win; null if both are empty or null."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    out = F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))
    return F.when(F.size(out) > 0, out)


def json_kind(json: Column, key: str) -> Column:
    """null, object, array, string, number, boolean or missing: the kind of a top-level value of a JSON object."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing").when(F.is_variant_null(value), "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    )


def without_json_comments(text: Column) -> Column:
    """JSON without // and /* */ comments; strings keep theirs."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")


def line_and_column(text: Column, offset: Column) -> Column:
    """struct(line, column), from 1, of a character offset from 0."""
    before = text.substr(F.lit(1), offset)
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def _errors(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(text)) for text, wrong in checks.items()]))


def _given_not_in(c: Column, values: Sequence[str]) -> Column:
    return (F.coalesce(c, F.lit("")) != "") & ~c.isin(*values)


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def task_errors(title: Column, type_: Column, status: Column, priority: Column, effort: Column) -> Column:
    return _errors(
        {
            "Title is required": _blank(title),
            "Title exceeds maximum length (200 characters)": F.length(title) > 200,
            "Invalid task type": _given_not_in(type_, TASK_TYPES),
            "Invalid task status": _given_not_in(status, TASK_STATUSES),
            "Invalid task priority": _given_not_in(priority, tuple(PRIORITIES)),
            "Invalid estimated effort format (use format like: 1h, 2d, 1w)": (F.coalesce(effort, F.lit("")) != "") & ~effort.rlike(r"^\d+[hdw]$"),
        }
    )


def dependency_errors(dependent: Column, dependency: Column, type_: Column) -> Column:
    return _errors(
        {
            "Dependent task ID is required": F.coalesce(dependent, F.lit("")) == "",
            "Dependency task ID is required": F.coalesce(dependency, F.lit("")) == "",
            "A task cannot depend on itself": dependent.eqNullSafe(dependency),
            "Invalid dependency type": _given_not_in(type_, DEPENDENCY_TYPES),
        }
    )


def rule_errors(name: Column, type_: Column, guidance: Column, priority: Column, threshold: Column, merge: Column) -> Column:
    return _errors(
        {
            "Name is required": _blank(name),
            "Name exceeds maximum length (200 characters)": F.length(name) > 200,
            "Invalid rule type": ~F.coalesce(type_.isin(*RULE_TYPES), F.lit(False)),
            "Guidance text is required": _blank(guidance),
            "Guidance text exceeds maximum length (10,000 characters)": F.length(guidance) > 10_000,
            "Priority must be between 1 and 10": (priority < 1) | (priority > 10),
            "Confidence threshold must be between 0 and 1": (threshold < 0) | (threshold > 1),
            "Invalid merge strategy": _given_not_in(merge, MERGES),
        }
    )


def note_errors(title: Column, content: Column, type_: Column, links: Column) -> Column:
    """links: an array of structs with a type."""
    kinds = F.transform(F.coalesce(links, F.array().cast("array<struct<type:string,id:string>>")), lambda x: F.coalesce(x["type"], F.lit("")))
    return _errors(
        {
            "Title is required": _blank(title),
            "Title exceeds maximum length (200 characters)": ~_blank(title) & (F.length(title) > 200),
            "Content is required": _blank(content),
            "Content exceeds maximum length (50,000 characters)": F.length(content) > 50_000,
            "Invalid note type": _given_not_in(type_, NOTE_TYPES),
            "Invalid entity type in entity links": F.exists(kinds, lambda t: ~t.isin(*LINKED_TYPES)),
        }
    )


def note_update_errors(content: Column, type_: Column) -> Column:
    """Of a change: a null content or type is left as it is."""
    return _errors({"Content cannot be empty": content.isNotNull() & _blank(content), "Content exceeds maximum length (50,000 characters)": F.length(content) > 50_000, "Invalid note type": _given_not_in(type_, NOTE_TYPES)})


def application_errors(entity_type: Column, entity_id: Column) -> Column:
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return _errors({"Entity type is required": missing(entity_type), "Entity ID is required": missing(entity_id)})


def rule_configuration_errors(name: Column, type_: Column, auto_apply: Column, template: Column, script: Column, threshold: Column, priority: Column) -> Column:
    missing = lambda c: F.coalesce(c, F.lit("")) == ""
    return _errors(
        {
            "Rule name is required": missing(name),
            "Rule type is required": missing(type_),
            "Automation rules with auto_apply must have a code_template": (type_ == "automation") & auto_apply & missing(template),
            "Constraint rules must have a validation_script": (type_ == "constraint") & missing(script),
            "Confidence threshold must be between 0 and 1": (threshold < 0) | (threshold > 1),
            "Priority must be between 1 and 10": (priority < 1) | (priority > 10),
        }
    )


def _tagged_blocks(lines: Column, tag: str) -> Column:
    """Blocks of a tag: an array of struct(a, b, closed), the lines (from 0) of the fences around them; an open one ends with the text."""

    def step(acc: Column, x: Column) -> Column:
        begins, ends = (acc["at"] < 0) & x["x"].rlike(rf"(?i)^```\s*{tag}\s*$"), (acc["at"] >= 0) & x["x"].rlike(r"^```\s*$")
        block = F.struct(acc["at"].alias("a"), x["k"].alias("b"), F.lit(True).alias("closed"))
        return F.struct(F.when(begins, x["k"]).when(ends, -1).otherwise(acc["at"]).alias("at"), F.when(ends, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"))

    rows = F.transform(lines, lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<a:int,b:int,closed:boolean>>").alias("out"))
    left = lambda acc: F.when(acc["at"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), F.size(lines).alias("b"), F.lit(False).alias("closed")))))
    return F.aggregate(rows, start, step, left)


def markdown_errors(text: Column) -> Column:
    """What is wrong with the fences of a Markdown text and with its diagrams, with their lines from 1; null texts have no errors.

    An odd number of fences; blocks of mermaid and excalidraw that aren't closed; diagrams of unknown type, with letters
    beyond ASCII, with // outside of links, or arrays in an erDiagram; drawings that aren't JSON.
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    none = F.array().cast("array<string>")
    told = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    inside = lambda b: F.transform(F.slice(lines, b["a"] + 2, b["b"] - b["a"] - 1), lambda x, j: F.struct((b["a"] + 2 + j).alias("n"), x.alias("x")))
    odd = F.when(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(```)"), F.lit(1))) % 2 != 0, F.array(F.lit("Unclosed code block detected (``` fence count is odd)"))).otherwise(none)
    open_ = lambda blocks, tag: F.transform(F.filter(blocks, lambda b: ~b["closed"]), lambda b: told(f"{tag} block starting at L", b["a"] + 1, " not closed with ```"))

    def of_diagram(b: Column) -> Column:
        head = F.get(F.filter(inside(b), lambda x: F.trim(x["x"]) != ""), 0)
        header, at = F.trim(F.coalesce(head["x"], F.lit(""))), F.coalesce(head["n"], b["a"] + 2)
        unknown = F.when(header.rlike(rf"(?i)^({DIAGRAMS})\b"), none).otherwise(F.array(told("Mermaid block L", at, ": missing or unknown diagram type")))

        def of_line(x: Column) -> Column:
            foreign = F.when(x["x"].rlike(r"[^\x00-\x7F]"), told("L", x["n"], ": Non-ASCII character in Mermaid (use ASCII arrows like --> or -.->)"))
            remark = F.when(F.contains(F.regexp_replace(x["x"], r"https?://\S+", ""), F.lit("//")), told("L", x["n"], ": Use Mermaid %% comments instead of //"))
            listed = F.when(header.rlike(r"(?i)^erDiagram\b") & (x["x"].rlike(r"\b[A-Za-z_]\w*\s*\[\s*\]")), told("L", x["n"], ": erDiagram does not support array syntax like string[]"))
            return F.array_compact(F.array(foreign, remark, listed))

        return F.concat(unknown, F.flatten(F.transform(inside(b), of_line)))

    def of_drawing(b: Column) -> Column:
        body = F.trim(F.array_join(F.transform(inside(b), lambda x: x["x"]), "\n"))
        return F.when((body != "") & F.try_parse_json(body).isNull(), told("Excalidraw block L", b["a"] + 2, ": invalid JSON"))

    diagrams, drawings = _tagged_blocks(lines, "mermaid"), _tagged_blocks(lines, "excalidraw")
    return F.concat(odd, open_(diagrams, "mermaid"), F.flatten(F.transform(diagrams, of_diagram)), open_(drawings, "excalidraw"), F.array_compact(F.transform(drawings, of_drawing)))


def _clean(*parts: Column) -> Column:
    filled = [F.nullif(p, F.lit("")) for p in parts]
    return F.trim(F.regexp_replace(F.concat_ws(" ", *filled), r"\s+", " "))


def component_text(name: Column, type_: Column, language: Column, description: Column, documentation: Column, code: Column) -> Column:
    """What a component's embedding is made of: name, type, language, texts, its first doc block (500) and code (300)."""
    block = F.substring(F.regexp_extract(code, r"(?s)(/\*\*.*?\*/)", 1), 1, 500)
    return _clean(name, type_, language, description, documentation, block, F.substring(code, 1, 300))


def task_text(title: Column, type_: Column, status: Column, priority: Column, description: Column, assignee: Column, tags: Column) -> Column:
    return _clean(title, type_, status, priority, description, assignee, F.array_join(tags, " "))


def note_text(title: Column, type_: Column, content: Column, links: Column, tags: Column) -> Column:
    told = F.array_join(F.transform(links, lambda x: F.concat(x["type"], F.lit(":"), x["id"])), " ")
    return _clean(title, type_, F.substring(content, 1, 1000), told, F.array_join(tags, " "))


def rule_text(name: Column, type_: Column, description: Column, guidance: Column, template: Column, script: Column) -> Column:
    return _clean(name, type_, description, guidance, F.substring(template, 1, 500), F.substring(script, 1, 200))


def expired_tags(tags: Column, changed: Column, old: Column) -> Column:
    """The tags that stay: automatic ones go when a linked file changed, contextual ones when the entity is old."""
    from quarry.functions.ranking import tag_class

    kind = lambda t: tag_class(t)
    return F.filter(tags, lambda t: ~((changed & (kind(t) == "auto")) | (old & (kind(t) == "contextual"))))


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def work_context(tags: Column, text: Column, files: Column, words: dict[str, Sequence[str]], patterns: dict[str, str]) -> Column:
    """struct(type, confidence) of a task: backend, frontend or full-stack.

    A tag of a side counts 10 (full-stack 5 for both), each of the side's words in the text 2, each
    file of its pattern 3. A side with over .7 of the points wins; without points .3.
    """
    score = {}
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    for side in ("backend", "frontend"):
        s = F.when(F.array_contains(low, side) | F.array_contains(low, f"{side}-only"), 10).otherwise(0) + F.when(F.array_contains(low, "full-stack"), 5).otherwise(0)
        for w in words[side]:
            s += F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)), 2).otherwise(0)
        score[side] = s + 3 * F.size(F.filter(F.coalesce(files, F.array().cast("array<string>")), _matches(patterns[side])))
    total = score["backend"] + score["frontend"]
    b, f = score["backend"] / total, score["frontend"] / total
    kind = F.when(total == 0, "full-stack").when(b > 0.7, "backend").when(f > 0.7, "frontend").otherwise("full-stack")
    sure = F.when(total == 0, 0.3).when(b > 0.7, b).when(f > 0.7, f).otherwise(0.5 + F.abs(b - f))
    return F.struct(kind.alias("type"), sure.alias("confidence"))


def link_target(doc_path: Column, url: Column) -> Column:
    """struct(path, anchor) of a link in a document: relative to its folder, `..` folded; an empty url is the document."""
    anchor = F.when(F.contains(url, F.lit("#")), F.regexp_extract(url, "#(.*)$", 1))
    bare = F.regexp_replace(url, "#.*$", "")
    joined = F.concat(F.regexp_replace(doc_path, "[^/]*$", ""), bare)
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc, p: F.when((p == "..") & ~F.element_at(acc, -1).isin("", ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    folded = F.array_join(F.aggregate(parts, F.array(F.lit("")), lambda acc, p: up(acc, p)), "/")
    path = F.when(bare.isin("", "."), doc_path).when(bare.startswith("/"), F.regexp_replace(bare, "^/", "")).otherwise(F.regexp_replace(folded, "^/", ""))
    return F.when(F.coalesce(url, F.lit("")) != "", F.struct(path.alias("path"), anchor.alias("anchor")))


def project_path(path: Column, root: str) -> Column:
    """A path relative to the project, with /; paths outside stay."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(posix.startswith(base), F.substring(posix, len(base) + 1, 1 << 30)).otherwise(posix)
