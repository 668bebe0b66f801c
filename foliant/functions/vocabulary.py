"""The closed vocabulary of the document format.

Everything in this module is a fixed value: results are right only if these names, patterns
and tables are exactly these.
"""

VERSION = "0.5"

# identifiers
CHUNK_ID = r"^[a-z0-9][a-z0-9_-]{0,63}\z"
PROPOSAL_ID = r"^p-[a-z0-9][a-z0-9_-]{0,63}\z"
RESERVED = ["body", "aim:theme", "aim:doc", "aim:version"]
CHUNK_MARK, CONTAINER_MARK = "data-aim", "data-aim-container"

# sections of the body, in order
BODY_ORDER = ["content", "aim-proposals", "aim-assets", "history", "embeddings"]
SCRIPT_TYPES = {
    "meta": "application/aim-meta+json",
    "doc": "application/aim-doc+json",
    "history": "application/aim-history+jsonl",
    "embeddings": "application/aim-embeddings+jsonl",
}

# elements
CONTAINERS = ["ul", "ol", "table", "aim-slide"]
SHELLS = ["thead", "tbody", "tfoot"]
ITEM_CARRIERS = {"li": ["ul", "ol"], "tr": ["table"]}
CONTENT = [
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "section", "blockquote", "figure", "figcaption", "pre", "div", "hr", "aim-page-break",
    "ul", "ol", "li", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "img", "svg", "use", "code", "a", "strong", "em", "b", "i",
    "u", "s", "sub", "sup", "mark", "br", "span",
]
VOID = ["meta", "img", "br", "hr", "link", "input"]
FORBIDDEN = [
    "iframe", "object", "embed", "form", "input", "button", "select", "textarea", "video", "audio", "canvas", "base", "frame", "frameset",
    "applet", "math",
]
ASSET_CONTENT = ["svg", "symbol", "image", "rect", "circle", "ellipse", "path", "g"]
HEAD_CONTENT = ["meta", "title", "style", "script"]

# attributes
GLOBAL_ATTRIBUTES = ["class", "style", "dir", "lang", "title"]
ATTRIBUTES = {
    "a": ["href"], "p": ["data-aim-num-prefix"], "h1": ["data-aim-num-prefix"], "h2": ["data-aim-num-prefix"], "h3": ["data-aim-num-prefix"],
    "h4": ["data-aim-num-prefix"], "h5": ["data-aim-num-prefix"], "h6": ["data-aim-num-prefix"], "ol": ["start"], "img": ["src", "alt"],
    "td": ["colspan", "rowspan"], "th": ["colspan", "rowspan"], "svg": ["role", "aria-label", "aria-hidden", "viewBox", "width", "height"],
    "use": ["href"], "aim-slide": ["data-aim-container", "style"],
}
FIRST_ATTRIBUTES = ["data-aim", "data-aim-container", "id", "class", "style"]
LAST_ATTRIBUTES = ["src", "href"]
SVG_CASE = {"viewbox": "viewBox", "preserveaspectratio": "preserveAspectRatio"}
URL_SCHEMES = {"a.href": ["https", "http", "mailto", "#"], "img.src": ["https", "http", "data:image/"]}

# inline style
STYLE_ORDER = ["left", "top", "width", "height", "transform", "z-index", "color", "background-color", "border-color", "font-size", "font-family"]
_MOVE = r"(rotate\(-?\d+(\.\d+)?deg\)|translate\(-?\d+(\.\d+)?px, ?-?\d+(\.\d+)?px\)|scale\(\d+(\.\d+)?\))"
STYLE_VALUES = {
    "left": r"^-?\d+(\.\d+)?px$",
    "top": r"^-?\d+(\.\d+)?px$",
    "width": r"^\d+(\.\d+)?px$",
    "height": r"^\d+(\.\d+)?px$",
    "transform": rf"^{_MOVE}( {_MOVE})*$",
    "z-index": r"^-?\d+$",
    "color": r"^#[0-9a-f]{6}$",
    "background-color": r"^#[0-9a-f]{6}$",
    "border-color": r"^#[0-9a-f]{6}$",
    "font-size": r"^\d+(\.\d+)?pt$",
    "font-family": r"^[A-Za-z0-9 ,'\-]+$",
}

# theme
THEME_SLOTS = {
    "--aim-brand-1": "color", "--aim-brand-2": "color", "--aim-brand-3": "color", "--aim-brand-4": "color",
    "--aim-font-heading": "font-stack", "--aim-font-body": "font-stack", "--aim-font-mono": "font-stack",
}
THEME_VALUES = {"color": r"^(#[0-9a-f]{3}|#[0-9a-f]{6}|rgb\(\d{1,3}, ?\d{1,3}, ?\d{1,3}\))$", "font-stack": r"^[A-Za-z0-9 ,'\-]+$"}

# classes: the parts of their names; the last of each pair joins every prefix with every step
TEXT_SIZES = ["xs", "sm", "base", "lg", "xl", "2xl", "3xl", "4xl", "5xl", "6xl", "7xl", "8xl", "9xl"]
ALIGNMENTS = ["left", "center", "right", "justify"]
FONT_WEIGHTS = ["normal", "medium", "semibold", "bold"]
LEADINGS = ["tight", "snug", "normal", "relaxed"]
SHADES = {"gray": ["50", "100", "200", "300", "400", "500", "600", "700", "800", "900"], "red": ["50", "600"], "green": ["50", "600"], "amber": ["50", "600"]}
PAINTED, BRANDS = ["text", "bg", "border"], 4
SPACING = (["m", "mt", "mb", "ml", "mr", "mx", "my", "p", "pt", "pb", "pl", "pr", "px", "py"], ["0", "1", "2", "3", "4", "6", "8", "10", "12", "16"])
SINGLES = [
    "italic", "underline", "line-through", "uppercase", "tracking-tight", "tracking-wide", "font-heading", "font-body", "font-mono", "text-white", "bg-white",
    "border", "border-t", "border-b", "rounded", "rounded-md", "rounded-lg", "rounded-full", "shadow", "list-none", "list-disc", "list-decimal",
]
LIST_FORMATS = ["list-lower-alpha", "list-upper-alpha", "list-lower-roman", "list-upper-roman"]
LIST_SUFFIXES, MARKERS, NUM_LEVELS = ["list-paren", "list-bare"], ["num-restart", "list-multilevel"], 9
PLACEMENT = {"num": ["p", "h1", "h2", "h3", "h4", "h5", "h6"], "list": ["ol", "ul"]}

# what came after the first version
CLASS_FLOORS = {"text-justify": "0.4", "text-7xl": "0.4", "text-8xl": "0.4", "text-9xl": "0.4"}
NUMBERING_FLOOR = "0.5"
ATTRIBUTE_FLOORS = {"data-aim-num-prefix": "0.5", "start": "0.5"}
PAINT, PAINT_FLOOR = ["color", "background-color", "border-color"], "0.3"
TYPOGRAPHY, TYPOGRAPHY_FLOOR = ["font-size", "font-family"], "0.4"


def numbering_classes() -> list[str]:
    return [*(f"num-{i}" for i in range(1, NUM_LEVELS + 1)), *LIST_FORMATS, *LIST_SUFFIXES, *MARKERS]


def classes() -> list[str]:
    """Every class of the closed vocabulary."""
    colours = [*(f"{family}-{shade}" for family, shades in SHADES.items() for shade in shades), *(f"brand-{i}" for i in range(1, BRANDS + 1))]
    made = [f"text-{x}" for x in TEXT_SIZES + ALIGNMENTS] + [f"font-{x}" for x in FONT_WEIGHTS] + [f"leading-{x}" for x in LEADINGS]
    made += [f"{use}-{x}" for use in PAINTED for x in colours] + [f"{use}-{step}" for use in SPACING[0] for step in SPACING[1]]
    return [*made, *SINGLES, *numbering_classes()]


def class_floor(name: str) -> str | None:
    """The version that brought a class, null for the first."""
    return CLASS_FLOORS.get(name) or (NUMBERING_FLOOR if name in numbering_classes() else None)


# pages, in millimetres
PAGE_SIZES = {"A3": (297.0, 420.0), "A4": (210.0, 297.0), "A5": (148.0, 210.0), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6), "Tabloid": (279.4, 431.8)}
PAGE_DEFAULT = {"size": "A4", "orientation": "portrait", "margin": "15mm"}
ORIENTATIONS = ["portrait", "landscape"]
MARGIN = r"^\d+(\.\d+)?mm$"
LARGEST_MARGIN, NEAR_SIZE = 100.0, 1.5

# history
ACTORS = ["human", "agent", "external"]
ACTIONS = ["add", "modify", "delete", "move"]
DECISIONS = ["accepted", "rejected", "superseded"]
ORIGINS = ["user", "undo", "redo", "reconcile"]
EVENT_FIELDS = {
    "direct_edit": (
        ["seq", "kind", "t", "target", "action", "author", "batch"],
        ["before", "after", "anchor", "from", "to", "origin", "explanation", "source"],
    ),
    "resolution": (
        ["seq", "kind", "t", "proposal", "target", "action", "decision", "proposed_by", "proposed_at", "decided_by", "batch"],
        ["before", "proposed", "applied", "anchor", "from", "to", "superseded_by", "explanation", "source"],
    ),
    "checkpoint": (["seq", "kind", "t", "label", "doc_hash"], []),
}
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"

# proposals: whether the action has a payload, and what it requires
PROPOSALS = {"add": (True, ["data-anchor-container"]), "modify": (True, ["data-for"]), "delete": (False, ["data-for"]), "move": (False, ["data-for", "data-anchor-container"])}
