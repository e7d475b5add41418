"""Ordered first-match classes of calls, statements and graph nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of callee texts.  The alternatives of a class that a more general one covers are left out.
ALLOC = (
    r"std::boxed::Box::<[^>]+>::new",
    r"std::boxed::Box::<std::vec::Vec<[^>]+>>::new",
    r"Box::<Vec<[^>]+>::new",
    r"(std::boxed::)?Box::<Node<[^>]+>>::new",
    r"std::slice::<impl \[i32\]>::into_vec::<std::alloc::Global>",
    r"std::slice::<impl \[&str\]>::into_vec::<std::alloc::Global>",
    r"<std::ffi::CString as std::convert::From<&std::ffi::CStr>>::from",
    r"std::ffi::CString::new::",
    r"std::boxed::Box::<std::option::Option<F>>::new",
    r"std::boxed::Box::<std::sync::mpsc::Sender<SegmentMessage>>::new",
)
MOVED_OUT = (
    r"std::boxed::Box::<[^>]+>::into_raw",
    r"std::boxed::Box::<std::vec::Vec<[^>]+>>::into_raw",
    r"Box::<Vec<[^>]+>>::into_raw",
    r"(std::boxed::)?Box::<Node<[^>]+>>::into_raw",
    r"std::ffi::CString::into_raw",
    r"std::boxed::Box::<std::option::Option<F>>::into_raw",
    r"std::boxed::Box::<std::sync::mpsc::Sender<SegmentMessage>>::into_raw",
    r"std::mem::forget::<std::boxed::Box<[^>]+>>",
    r"std::mem::forget::<std::vec::Vec<[^>]+>>",
    r"std::mem::forget::<Box<Vec<[^>]+>>",
    r"std::mem::forget::<std::ffi::CString>",
)
RE_OWNED = (
    r"std::boxed::Box::<[^>]+>::from_raw",
    r"std::boxed::Box::<std::vec::Vec<[^>]+>>::from_raw",
    r"(std::boxed::)?Box::<Node<[^>]+>>::from_raw",
    r"std::ffi::CStr::from_raw",
    r"std::ffi::CString::from_raw",
    r"std::boxed::Box::<std::sync::mpsc::Sender<SegmentMessage>>::from_raw",
)
#: What the detector takes for a return of ownership.
RE_OWNED_EVENT = (RE_OWNED[0], RE_OWNED[1], RE_OWNED[2], RE_OWNED[4])
#: What marks the return place of an entry block as re-owned.
RE_OWNED_MARK = (*RE_OWNED[:3], RE_OWNED[4], RE_OWNED[5], r"std::boxed::Box<u8>::from_raw")
RENAMES = ("std::result::Result::<std::ffi::CString, std::ffi::NulError>::expect", "std::ffi::CStr::from_ptr::<'_>")
POINTER_CASTS = (" as *mut i32 (PtrToPtr)", " as *const i8 (PtrToPtr)", " as *mut std::string::String (PtrToPtr)")
#: Allocations that the drawing of a graph colours, besides those of the plain and C number types.
DRAWN_TYPES = (
    *(f"{kind}{bits}" for kind in "iu" for bits in (8, 16, 32, 64, 128)), "f32", "f64", "bool", "char", "std::string::String",
    *(f"std::ffi::c_{t}" for t in ("void", "char", "int", "uint", "long", "ulong", "longlong", "ulonglong", "short", "ushort", "schar", "uchar")),
)
DRAWN_CALLS = (ALLOC[4], ALLOC[5], r"(?i:cstring as std::convert::from)", r"(?i:std::ffi::cstring::new::)", r"(?i:std::boxed::box::<&str>::new)")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def call_class(details: Column, called: Column, match_scope: str = "details") -> Column:
    """rename, alloc, moved, reowned, drop or other, the first that fits.

    ``match_scope`` says where classes after the first look: in the whole text
    of the call (``details``, with its source path) or in the callee only
    (``callee``), where a path with the word drop does no harm.
    """
    text = {"details": details, "callee": called}[match_scope]
    return (
        F.when(contains_any(called, RENAMES), "rename")
        .when(any_of(text, ALLOC), "alloc")
        .when(any_of(text, MOVED_OUT), "moved")
        .when(any_of(text, RE_OWNED), "reowned")
        .when(text.contains("drop"), "drop")
        .otherwise("other")
    )


def call_mark(called: Column) -> Column:
    """What a call adds to the taint of its return place: assign and whether the moved operand loses its own."""
    quiet = called.contains("std::boxed::Box::<i32>::new") | called.contains("vec::new") | any_of(called, (ALLOC[6], ALLOC[7]))
    return (
        F.when(called.contains("NOT_HANDLED"), "NOT_HANDLED")
        .when(any_of(called, MOVED_OUT), "take")
        .when(quiet, "")
        .when(any_of(called, RE_OWNED_MARK), "take")
        .when(called.contains("std::mem::drop::"), "assign")
        .otherwise("")
    )


def statement_class(kind: Column, rvalue: Column, place: Column) -> Column:
    """link, none, move, alias or set of an assignment; null for statements without effect."""
    has_place = place.isNotNull()
    return F.when((kind == "Assign") & rvalue.isNotNull(), (
        F.when(rvalue.startswith("&"), F.when(has_place, "link"))
        .when(rvalue.contains("Box::new") | rvalue.contains("vec::new"), None)
        .when(rvalue.contains("move") & ~rvalue.contains("["), F.when(has_place, "move"))
        .when(rvalue.contains("copy ") & contains_any(rvalue, POINTER_CASTS), F.when(has_place, "alias"))
        .when(rvalue.contains("&(*"), None)
        .when(has_place, "set")
    ))


def call_target(called: Column, is_ffi: Column, is_known: Column) -> Column:
    """ffi, closure, internal or external."""
    return F.when(is_ffi, "ffi").when(called.contains("{closure"), "closure").when(is_known, "internal").otherwise("external")


def use_pattern(details: Column) -> Column:
    """(pattern, variable) of the first use pattern that a statement's text fits: deref, copy_deref, cast; null without one."""
    shapes = (("&(*", r"&\(\*([^)]*)\)", "deref"), ("copy (*", r"copy \(\*([^)]*)\)", "copy_deref"))
    found = F.when(details.contains("copy ") & details.contains(" as"), _captured(details, r"(?s)copy (.*?) as", "cast"))
    for word, pattern, name in reversed(shapes):
        found = F.when(details.contains(word), _captured(details, pattern, name)).otherwise(found)
    return found


def _captured(text: Column, pattern: str, name: str) -> Column:
    return F.when(text.rlike(pattern), F.struct(F.lit(name).alias("pattern"), F.trim(F.regexp_extract(text, pattern, 1)).alias("variable")))


def dropped_variable(details: Column) -> Column:
    """The operand of ``drop(...)``, null without one."""
    return F.when(details.rlike(r"drop\([^)]*\)"), F.trim(F.regexp_extract(details, r"drop\(([^)]*)\)", 1)))


def is_c_free(info: Column, kind: Column) -> Column:
    return info.contains("@free(") & (kind == "FunCallBlock")


def node_colour(label: Column, node_type: Column, source: Column) -> Column:
    """The fill colour of a graph node in a drawing."""
    drawn = any_of(label, (rf"std::boxed::Box::<({'|'.join(DRAWN_TYPES)})>::new", *DRAWN_CALLS))
    rust = F.when(drawn, "yellow").when(label.contains("drop"), "green").when(label.contains("into_raw") | label.contains("std::mem::forget"), "red").otherwise("gray89")
    c = F.when(label.contains("@free") & source.contains("CallICFGNode: "), "green").otherwise("turquoise")
    return F.when(node_type == "Mir", rust).when(node_type == "Llvm", c).otherwise("white")
