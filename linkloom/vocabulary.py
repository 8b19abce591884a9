"""Names that pages, saved queries and callers already use on the wire."""

# --- fixed values: page markup ------------------------------------------------
TERM_ELEMENT = "octo-thorpe"
REL_TERM = "octo:octothorpes"
REL_ENDORSE = "octo:endorses"
REL_BOOKMARK = "octo:bookmarks"
REL_CITE = "octo:cites"
REL_BUTTON = "octo:button"
REL_INDEX = "octo:index"
REL_RULES = "octo:harmonizer"
REL_IMAGE = "octo:image"
META_CONTACT = "octo:contact"
META_TYPE = "octo:type"
META_POST_DATE = "octo:postDate"
META_POLICY = "octo-policy"
META_RULES = "octo-harmonizer"
ATTR_TERMS = "data-octothorpes"
ATTR_IMAGE = "data-octo-image"
ATTR_DATE = "data-octodate"
TYPE_PREFIX = "octo:"
ASSERTS = "octo:asserts"
TERM_PATH = "~/"
# --- end of fixed values ------------------------------------------------------

# --- fixed values: query names ------------------------------------------------
OBJECT_WHAT = ("everything", "blobjects", "whatever")
LINK_WHAT = ("links", "mentions", "backlinks", "citations", "bookmarks", "pages")
TERM_WHAT = ("thorpes", "octothorpes", "tags", "terms")
RUNNABLE_LINK_WHAT = ("pages", "links", "backlinks")

# by -> (object class, subtype)
BY = {
    "thorped": ("termsOnly", ""),
    "octothorped": ("termsOnly", ""),
    "tagged": ("termsOnly", ""),
    "termed": ("termsOnly", ""),
    "linked": ("notTerms", ""),
    "mentioned": ("notTerms", ""),
    "backlinked": ("pagesOnly", "Backlink"),
    "cited": ("notTerms", "Cite"),
    "bookmarked": ("notTerms", "Bookmark"),
    "posted": ("none", ""),
    "all": ("none", ""),
    "in-webring": ("all", ""),
    "members": ("all", ""),
    "member-of": ("all", ""),
}
TERM_MODE = "octothorpes"
AS_SPEC = "multipass"
AS_DEBUG = "debug"
RING_BY = ("in-webring", "members", "member-of")
RELATION_TERM_BY = ("linked", "mentioned", "backlinked", "cited", "bookmarked")

# match -> (subject mode, object mode); None keeps the default
MATCH = {
    "exact": ("exact", None),
    "fuzzy": ("fuzzy", "fuzzy"),
    "fuzzy-s": ("fuzzy", None),
    "fuzzy-subject": ("fuzzy", None),
    "fuzzy-o": (None, "fuzzy"),
    "fuzzy-object": (None, "fuzzy"),
    "very-fuzzy-o": (None, "very-fuzzy"),
    "very-fuzzy-object": (None, "very-fuzzy"),
    "very-fuzzy": ("fuzzy", "very-fuzzy"),
    "all": ("exact", "all"),
}

SUBTYPES = {
    "bookmark": "Bookmark",
    "Bookmark": "Bookmark",
    "cite": "Cite",
    "citation": "Cite",
    "Cite": "Cite",
    "button": "Button",
    "Button": "Button",
}
# --- end of fixed values ------------------------------------------------------
