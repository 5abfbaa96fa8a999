"""Where the values of a call come from, read off one function's syntax tree.

A value is graded by its strongest source: a parameter, a local variable, the result of another call, or nothing but
literals; what fits none is unknown. The grades of a call's arguments make a decision about the call, those of the dangerous
calls of a body one about the function, those of its scopes one about the class. All of it is per file and runs with the parse.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

# The grades, strongest first, and those that show that data flows.
GRADES = ("parameter_match", "local_var_match", "call_result_match", "literal_only", "no_args", "unknown")
DATA = GRADES[:3]
PARAMETER, LOCAL, RESULT, LITERAL, NOTHING, UNKNOWN = GRADES

Function = ast.FunctionDef | ast.AsyncFunctionDef


def flow_kind(grade: str) -> str:
    """The flow of an edge that a decision is about."""
    return "data" if grade in DATA else "control"


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of an attribute chain that begins at a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _root(node: ast.AST) -> str | None:
    name = dotted(node)
    return name.partition(".")[0] if name else None


def _own_attribute(node: ast.AST | None) -> str | None:
    """``x`` of ``self.x``."""
    return node.attr if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self" else None


@dataclass
class Names:
    """What a function's values may come from. ``attributes`` also follows attributes of parameters and variables."""

    parameters: set[str] = field(default_factory=set)
    variables: set[str] = field(default_factory=set)
    own: set[str] = field(default_factory=set)
    attributes: bool = False


def parameters(function: Function) -> list[str]:
    """Its parameters in order, without the instance and the class."""
    a = function.args
    named = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    return [x.arg for x in named if x.arg not in ("self", "cls")]


def names_of(function: Function, attributes: bool = False) -> Names:
    """Parameters, variables and the instance attributes that are set from them, directly or through each other."""
    stored: list[tuple[str, ast.AST | None]] = []
    variables = set()
    for node in ast.walk(function):
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            variables.add(node.id)
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            stored += [(own, node.value) for own in map(_own_attribute, targets) if own]
    found = Names(set(parameters(function)), variables - {"self", "cls"}, set(), attributes)
    if attributes:
        known = found.parameters | found.variables
        fed = {a for a, v in stored if isinstance(v, ast.Name) and v.id in known}
        size = -1
        while size != len(fed):
            size = len(fed)
            fed |= {a for a, v in stored if _own_attribute(v) in fed}
        found.own = fed
    return found


def _literal(node: ast.AST | None) -> bool:
    match node:
        case ast.Constant():
            return True
        case ast.List() | ast.Tuple() | ast.Set():
            return all(map(_literal, node.elts))
        case ast.Dict():
            return all(map(_literal, [*node.keys, *node.values]))
    return False


def grade(node: ast.AST, names: Names) -> str:
    """The grade of one value."""
    match node:
        case ast.Await():
            return grade(node.value, names) if not isinstance(node.value, ast.Await) else UNKNOWN
        case ast.Call():
            return RESULT
        case ast.Constant():
            return LITERAL
        case ast.Name():
            return PARAMETER if node.id in names.parameters else LOCAL if node.id in names.variables else UNKNOWN
        case ast.Attribute():
            reached = names.attributes and _root(node) in names.parameters | names.variables
            return PARAMETER if _own_attribute(node) in names.own or reached else UNKNOWN
        case ast.JoinedStr():
            return _together([p.value for p in node.values if isinstance(p, ast.FormattedValue)], names)
        case ast.List() | ast.Tuple() | ast.Set():
            return LITERAL if _literal(node) else _together(node.elts, names)
        case ast.Dict() if None not in node.keys:
            return LITERAL if all(map(_literal, node.values)) else _together(node.values, names)
    return UNKNOWN


def _together(parts: list[ast.AST], names: Names) -> str:
    grades = {grade(p, names) for p in parts}
    return PARAMETER if PARAMETER in grades else LOCAL if LOCAL in grades else UNKNOWN


def evidence(node: ast.AST) -> str:
    """A word for what stands in an argument's place."""
    match node:
        case ast.Await():
            return evidence(node.value)
        case ast.Constant():
            return "literal"
        case ast.Name():
            return node.id
        case ast.Attribute():
            root = _root(node)
            return f"{root}.{node.attr}" if root else "attribute"
        case ast.Call():
            return "call"
        case ast.JoinedStr():
            return "f-string"
        case ast.List() | ast.Tuple() | ast.Set():
            return "collection"
        case ast.Dict():
            return "mapping"
    return "expression"


def arguments(call: ast.Call) -> list[ast.AST]:
    return [*call.args, *(k.value for k in call.keywords)]


def of_call(call: ast.Call, names: Names) -> tuple[str, list[str]]:
    """(grade, evidence) of a call: its strongest argument decides, literals only where there is nothing else."""
    given = arguments(call)
    if not given:
        return NOTHING, []
    grades = [grade(x, names) for x in given]
    best = min(grades, key=GRADES.index)
    if best == LITERAL and UNKNOWN in grades:
        best = UNKNOWN
    return best, list(map(evidence, given))


def of_body(function: Function, dangerous: Callable[[ast.Call], bool], commits: Callable[[ast.Call], bool]) -> tuple[str, list[str]]:
    """(grade, evidence) of a function by its dangerous calls, then by those that commit: the first that data reaches makes it
    ``parameter_match``, as does a commit without arguments in a function that has parameters; else literals if any call has
    nothing else."""
    calls = [n for n in ast.walk(function) if isinstance(n, ast.Call)]
    looked_at = [c for c in calls if dangerous(c)]
    looked_at += [c for c in calls if commits(c) and c not in looked_at]
    if not looked_at:
        return UNKNOWN, []
    names = names_of(function, attributes=True)
    literal = None
    for call in looked_at:
        best, shown = of_call(call, names)
        if best == NOTHING:
            if names.parameters and commits(call):
                return PARAMETER, ["commit of parameters"]
        elif best in DATA:
            return PARAMETER, shown
        elif best == LITERAL:
            literal = shown
    return (LITERAL, literal) if literal is not None else (UNKNOWN, ["no evidence in arguments"])


def of_class(node: ast.ClassDef, dangerous, commits) -> tuple[str, list[str]]:
    """(grade, evidence) of a class: that of its first scope with data, then of its first with literals; the methods are
    scopes, and the statements of its body are one more."""
    scopes: dict[str, Function] = {}
    for x in node.body:
        if isinstance(x, Function):
            scopes.setdefault(f"method:{x.name}", x)
    rest = [x for x in node.body if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    if rest:
        scopes["class_body"] = ast.FunctionDef(name="", args=ast.arguments(posonlyargs=[], args=[], vararg=None, kwonlyargs=[], kw_defaults=[], kwarg=None, defaults=[]), body=rest, decorator_list=[])
    decided = {name: of_body(f, dangerous, commits) for name, f in scopes.items()}
    for wanted in (PARAMETER, LITERAL):
        for name, (found, shown) in decided.items():
            if found == wanted:
                return wanted, [name, *shown]
    return UNKNOWN, ["no scope passes data"]


def returns_data(function: Function) -> bool:
    """Whether it yields, or returns anything but None."""
    return any(isinstance(x, (ast.Yield, ast.YieldFrom)) or isinstance(x, ast.Return) and x.value is not None and not (isinstance(x.value, ast.Constant) and x.value.value is None) for x in ast.walk(function))


def of_tools(named: Iterable[str], prompt: str | None) -> tuple[str, list[str]]:
    """(grade, evidence) of an agent's use of tools: whether its system prompt names one of them as a whole word."""
    import re

    if not prompt or not prompt.strip():
        return UNKNOWN, ["no system prompt"]
    for name in named:
        if name and re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", prompt):
            return PARAMETER, [f"named in the prompt: {name}"]
    return UNKNOWN, ["no tool named in the prompt"]


def of_model(node: ast.AST | None, assigned: dict[str, ast.AST], given: set[str]) -> tuple[str, list[str]]:
    """(grade, evidence) of an agent's model: followed through assignments and client constructors to a literal name or a
    parameter."""
    passed: set[str] = set()
    while node is not None:
        match node:
            case ast.Constant():
                return (LITERAL, ["literal model name"]) if isinstance(node.value, str) else (UNKNOWN, ["model is no text"])
            case ast.Name():
                if node.id in given:
                    return PARAMETER, [f"model from parameter {node.id}"]
                if node.id in passed or node.id not in assigned:
                    return UNKNOWN, [f"model {node.id} is assigned nowhere" if node.id not in passed else "model is assigned in a circle"]
                passed.add(node.id)
                node = assigned[node.id]
            case ast.Call():
                node = next((k.value for key in ("model", "model_name") for k in node.keywords if k.arg == key), None)
                if node is None:
                    return UNKNOWN, ["client sets no model"]
            case _:
                return UNKNOWN, ["model is no name and no literal"]
    return UNKNOWN, ["no model"]


def of_tool(function: ast.AST | None) -> tuple[str, list[str]]:
    """(grade, evidence) of a provided tool by the parameters it declares."""
    if not isinstance(function, Function):
        return UNKNOWN, ["signature not visible"]
    return (PARAMETER, ["declares parameters"]) if parameters(function) else (NOTHING, ["declares no parameters"])
