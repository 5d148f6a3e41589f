"""What a statement may contain, decided on Spark's parsed tree.

The statement is parsed by Spark, and every node and expression of the tree is visited, subqueries and common table expressions too. A
node, function or relation passes only if a list below or the catalog names it. No text of the statement or of a printed plan is
searched, so neither a long select list nor a word in a literal changes the verdict.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# The plan nodes of reading statements, as Spark's parser names them.
READ_NODES = frozenset("""
Project Filter Aggregate Join LateralJoin AsOfJoin Sort GlobalLimit LocalLimit Limit Offset Tail Distinct Deduplicate Union Intersect Except Window WithWindowDefinition
SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation
UnresolvedHaving Generate Pivot Unpivot Sample UnresolvedHint UnresolvedTableValuedFunction UnresolvedTVFAliases Expand
""".split())
# The commands that show what is there, and what they may hold.
SHOW_COMMANDS = frozenset("""
ShowTables ShowTablesCommand ShowViews ShowColumns ShowColumnsCommand ShowNamespaces ShowFunctions ShowFunctionsCommand ShowPartitions ShowTableProperties ShowCreateTable
ShowCatalogsCommand ShowCurrentNamespaceCommand DescribeRelation DescribeColumn DescribeNamespace DescribeFunction DescribeFunctionCommand DescribeQueryCommand
ExplainCommand CurrentNamespace UnresolvedNamespace UnresolvedTable UnresolvedView UnresolvedTableOrView UnresolvedFunctionName
""".split())
# Groups of built-in functions, as Spark documents them. The group misc_funcs is left out, since it holds the functions that
# call JVM methods, raise errors or name files and hosts; the harmless ones of it are listed apart.
FUNCTION_GROUPS = frozenset("""
agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs date_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs
map_funcs math_funcs predicate_funcs sketch_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs xml_funcs geo_funcs
""".split())
EXTRA_FUNCTIONS = frozenset("typeof uuid equal_null current_catalog current_database current_schema current_user user version".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
AGGREGATE_GROUP = "agg_funcs"


class NotAllowed(ValueError):
    """The statement holds something that the gate does not know to be a read."""


def check_statement(spark: SparkSession, sql: str, functions: Collection[str] = (), relations: Collection[str] = ()) -> None:
    """Raises :class:`NotAllowed` unless ``sql`` only reads tables and views of the catalog.

    ``functions`` are further allowed function names, user functions for example; ``relations`` are names that the caller binds. A
    statement that Spark cannot parse raises Spark's parse error.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    _Walk(spark, {f.lower() for f in functions}, {r.lower() for r in relations}).plan(plan, frozenset())


def check_aggregate(spark: SparkSession, formula: str) -> None:
    """Raises :class:`NotAllowed` unless ``formula`` is an expression over aggregates: columns occur inside of them only, and no subquery.

    A formula that Spark cannot parse is not allowed either.
    """
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(formula)
    except Exception as exc:
        raise NotAllowed(f"not an expression: {formula!r}") from exc
    walk = _Walk(spark, set(), set(), subqueries=False)
    walk.expression(tree, frozenset())
    if not walk.aggregates:
        raise NotAllowed(f"no aggregate: {formula!r}")
    loose = _outside(walk, tree)
    if loose:
        raise NotAllowed(f"{loose} stands outside of an aggregate: {formula!r}")


def _outside(walk: _Walk, node) -> str | None:
    """The first column that no aggregate encloses."""
    if _kind(node) == "UnresolvedFunction" and walk.group(_parts(node.nameParts())[-1].lower()) == AGGREGATE_GROUP:
        return None
    if _kind(node) in ("UnresolvedAttribute", "UnresolvedStar"):
        return str(node)
    return next((found for found in (_outside(walk, c) for c in _each(node.children())) if found), None)


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _each(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _parts(names) -> list[str]:
    return [str(n) for n in _each(names)]


class _Walk:
    def __init__(self, spark: SparkSession, functions: set[str], relations: set[str], subqueries: bool = True):
        self.spark, self.functions, self.relations, self.subqueries = spark, functions, relations, subqueries
        self.aggregates = 0
        self._groups: dict[str, str | None] = {}

    def plan(self, node, names: frozenset[str]) -> None:
        """``names`` are the common table expressions in scope."""
        kind = _kind(node)
        if kind == "UnresolvedWith":
            self._with(node, names)
            return
        if kind not in READ_NODES and kind not in SHOW_COMMANDS:
            raise NotAllowed(f"{kind} is not part of a read-only query")
        if kind == "UnresolvedRelation":
            self._relation(_parts(node.multipartIdentifier()), names)
        elif kind in ("UnresolvedTable", "UnresolvedView", "UnresolvedTableOrView"):
            self._relation(_parts(node.multipartIdentifier()), frozenset())
        elif kind == "UnresolvedTableValuedFunction":
            self._table_function(_parts(node.name()))
        elif kind == "ExplainCommand":
            self.plan(node.logicalPlan(), names)
        elif kind == "DescribeQueryCommand":
            self.plan(node.plan(), names)
        for child in _each(node.children()):
            self.plan(child, names)
        for inner in _each(node.expressions()):
            self.expression(inner, names)

    def _with(self, node, names: frozenset[str]) -> None:
        scope = names
        relations = [(str(pair._1()), pair._2()) for pair in _each(node.cteRelations())]
        if node.allowRecursion():
            scope = scope | {name.lower() for name, _ in relations}
        for name, body in relations:
            self.plan(body, scope)
            scope = scope | {name.lower()}
        self.plan(node.child(), scope)

    def _relation(self, parts: list[str], names: frozenset[str]) -> None:
        """Only names that the catalog holds: ``format.`path` `` reads files and is no table."""
        if len(parts) == 1 and (parts[0].lower() in names or parts[0].lower() in self.relations):
            return
        quoted = ".".join("`" + p.replace("`", "``") + "`" for p in parts)
        try:
            known = self.spark.catalog.tableExists(quoted)
        except AnalysisException:  # no catalog takes a name of that form
            known = False
        if not known:
            raise NotAllowed(f"{quoted} is not a table or view of the catalog, so this is not a read-only query")

    def _table_function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) > 1 or (name not in TABLE_FUNCTIONS and name not in self.functions):
            raise NotAllowed(f"table function {'.'.join(parts)} is not part of a read-only query")

    def expression(self, node, names: frozenset[str]) -> None:
        kind = _kind(node)
        if kind == "UnresolvedFunction":
            self._function(_parts(node.nameParts()))
        elif kind == "UnresolvedGenerator":
            self._table_function([str(node.name().funcName())])
        elif kind.startswith(("ExpressionWithUnresolvedIdentifier", "UnresolvedIdentifier", "ScriptInput")):
            raise NotAllowed(f"{kind} is not part of a read-only query")
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            if not self.subqueries:
                raise NotAllowed("a subquery is not part of an aggregate expression")
            self.plan(node.plan(), names)
        for child in _each(node.children()):
            self.expression(child, names)

    def _function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) == 1 and name in self.functions:
            return
        group = self.group(name) if len(parts) == 1 or [p.lower() for p in parts[:-1]] in (["builtin"], ["system", "builtin"]) else None
        if group not in FUNCTION_GROUPS and name not in EXTRA_FUNCTIONS:
            raise NotAllowed(f"function {'.'.join(parts)} is not part of a read-only query")
        self.aggregates += group == AGGREGATE_GROUP

    def group(self, name: str) -> str | None:
        """Documented group of a built-in function; none for functions that a user registered under any name."""
        if name not in self._groups:
            jvm, catalog = self.spark._jvm, self.spark._jsparkSession.sessionState().catalog()
            ident = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
            builtin = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().lookupFunction(ident)
            found = None
            if builtin.isDefined() and catalog.lookupFunctionInfo(ident).getClassName() == builtin.get().getClassName():
                found = str(builtin.get().getGroup())
            self._groups[name] = found
        return self._groups[name]
