"""A small literal table of sources, so that facts which SQL cannot read out of contents can be held against stated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STORE = '''defmodule Shop.Store do
  @moduledoc "Keeps the stock."
  use GenServer
  require Logger
  alias Shop.{Item, Order}
  alias Shop.Report, as: Rep
  import Enum, only: [map: 2]
  @behaviour Shop.Backend
  @type key(a) :: {a, integer}
  @typep row :: map
  @limit 10

  defstruct [:name, stock: 0]

  @spec fetch(key, integer) :: row
  @doc "Fetches one."
  def fetch(key, most \\\\ @limit) when most > 0 do
    table = :ets.new(:stock, [:set, :public, :named_table])
    rows = Enum.map(table, fn r -> {r, key, most + key} end)
    case rows do
      [] -> raise ArgumentError, "none"
      [_ | _] -> Rep.print(rows)
    end
  end

  def fetch(nil, _), do: throw(:empty)

  @impl true
  def init(args), do: {:ok, build(args)}

  defp build(%{name: name} = args) do
    add = fn x, {y, ^name} -> z = x + y; [z | args] end
    with {:ok, v} <- add.(1, 2), do: apply(Item, :new, [v, &Order.total/1])
  end

  defmodule Error do
    defexception [:message]
    defmacro wrap(q), do: quote(do: unquote(q))
  end
end
'''
TREE = '''defmodule Shop.Tree do
  use Supervisor

  def init(_) do
    Logger.info("up")
    children = [Shop.Store, {Shop.Cache, []}, {Shop.DeepSupervisor, name: Deep}]
    Supervisor.init(children, strategy: :rest_for_one, max_restarts: 7, max_seconds: 2)
  end
end

defprotocol Shop.Priced do
  def price(x)
end

defimpl Shop.Priced, for: Shop.Item do
  def price(i), do: if(i.sale, do: 1, else: i.price)
end
'''
#: (file_id, path, content, mtime): a superseded state, a state delivered twice, a file that does not parse and a null.
SOURCES = [
    (1, "lib/store.ex", "defmodule Shop.Old do\nend\n", 1),
    (1, "lib/store.ex", STORE, 2),
    (2, "lib/tree.ex", TREE, None),
    (2, "lib/tree.ex", TREE, None),
    (3, "lib/broken.ex", "defmodule Shop.Broken do\n  def (\nend\n", 1),
    (4, "lib/none.ex", None, 1),
]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "file_id bigint, path string, content string, mtime bigint")


#: Rows of the facts, read off the sources by hand: the columns with their SQL types, then one tuple a row.
STATED: dict[str, tuple[str, list[tuple]]] = {
    "modules": ("file_id BIGINT, name VARCHAR, definer VARCHAR, line INTEGER, depth INTEGER, parent VARCHAR", [
        (1, 'Shop.Store', 'defmodule', 1, 0, None),
        (1, 'Shop.Store.Error', 'defmodule', 36, 2, 'Shop.Store'),
        (2, 'Shop.Priced', 'defprotocol', 11, 0, None),
        (2, 'Shop.Priced.Shop.Item', 'defimpl', 15, 0, None),
        (2, 'Shop.Tree', 'defmodule', 1, 0, None),
    ]),
    "functions": ("file_id BIGINT, module VARCHAR, name VARCHAR, arity INTEGER, definer VARCHAR, clauses BIGINT, min_arity INTEGER, line INTEGER", [
        (1, 'Shop.Store', 'build', 1, 'defp', 1, 1, 31),
        (1, 'Shop.Store', 'fetch', 2, 'def', 2, 1, 17),
        (1, 'Shop.Store', 'init', 1, 'def', 1, 1, 29),
        (1, 'Shop.Store.Error', 'wrap', 1, 'defmacro', 1, 1, 38),
        (2, 'Shop.Priced', 'price', 1, 'def', 1, 1, 12),
        (2, 'Shop.Priced.Shop.Item', 'price', 1, 'def', 1, 1, 16),
        (2, 'Shop.Tree', 'init', 1, 'def', 1, 1, 4),
    ]),
    "clauses": ("file_id BIGINT, module VARCHAR, name VARCHAR, arity INTEGER, definer VARCHAR, defaults INTEGER, line INTEGER, clause_order INTEGER", [
        (1, 'Shop.Store', 'build', 1, 'defp', 0, 31, 1),
        (1, 'Shop.Store', 'fetch', 2, 'def', 0, 26, 2),
        (1, 'Shop.Store', 'fetch', 2, 'def', 1, 17, 1),
        (1, 'Shop.Store', 'init', 1, 'def', 0, 29, 1),
        (1, 'Shop.Store.Error', 'wrap', 1, 'defmacro', 0, 38, 1),
        (2, 'Shop.Priced', 'price', 1, 'def', 0, 12, 1),
        (2, 'Shop.Priced.Shop.Item', 'price', 1, 'def', 0, 16, 1),
        (2, 'Shop.Tree', 'init', 1, 'def', 0, 4, 1),
    ]),
    "parameters": ("file_id BIGINT, module VARCHAR, name VARCHAR, arity INTEGER, parameter_kind VARCHAR, text VARCHAR, line INTEGER, position INTEGER", [
        (1, 'Shop.Store', 'build', 1, 'pattern', '=', 31, 0),
        (1, 'Shop.Store', 'fetch', 2, 'default', '\\\\', 17, 1),
        (1, 'Shop.Store', 'fetch', 2, 'pattern', 'nil', 26, 0),
        (1, 'Shop.Store', 'fetch', 2, 'simple', '_', 26, 1),
        (1, 'Shop.Store', 'fetch', 2, 'simple', 'key', 17, 0),
        (1, 'Shop.Store', 'init', 1, 'simple', 'args', 29, 0),
        (1, 'Shop.Store.Error', 'wrap', 1, 'simple', 'q', 38, 0),
        (2, 'Shop.Priced', 'price', 1, 'simple', 'x', 12, 0),
        (2, 'Shop.Priced.Shop.Item', 'price', 1, 'simple', 'i', 16, 0),
        (2, 'Shop.Tree', 'init', 1, 'simple', '_', 4, 0),
    ]),
    "calls": ("file_id BIGINT, module VARCHAR, fun VARCHAR, fun_arity INTEGER, call_kind VARCHAR, name VARCHAR, arity INTEGER, line INTEGER, position INTEGER", [
        (1, 'Shop.Store', 'build', 1, 'dynamic', 'add', 2, 33, 4),
        (1, 'Shop.Store', 'build', 1, 'dynamic', 'apply', 3, 33, 5),
        (1, 'Shop.Store', 'fetch', 2, 'remote', ':ets.new', 2, 18, 0),
        (1, 'Shop.Store', 'fetch', 2, 'remote', 'Enum.map', 2, 19, 1),
        (1, 'Shop.Store', 'fetch', 2, 'remote', 'Rep.print', 1, 22, 2),
        (1, 'Shop.Store', 'init', 1, 'local', 'build', 1, 29, 3),
        (2, 'Shop.Tree', 'init', 1, 'remote', 'Logger.info', 1, 5, 0),
        (2, 'Shop.Tree', 'init', 1, 'remote', 'Supervisor.init', 2, 7, 1),
    ]),
    "directives": ("file_id BIGINT, module VARCHAR, directive VARCHAR, line INTEGER, scope VARCHAR, renamed VARCHAR, has_only BOOLEAN, has_except BOOLEAN, position INTEGER, target VARCHAR", [
        (1, 'Shop.Store', 'alias', 5, 'module', '', False, False, 0, 'Shop.Item'),
        (1, 'Shop.Store', 'alias', 5, 'module', '', False, False, 0, 'Shop.Order'),
        (1, 'Shop.Store', 'alias', 6, 'module', 'Rep', False, False, 1, 'Shop.Report'),
        (1, 'Shop.Store', 'import', 7, 'module', '', True, False, 0, 'Enum'),
        (1, 'Shop.Store', 'require', 4, 'module', '', False, False, 0, 'Logger'),
        (1, 'Shop.Store', 'use', 3, 'module', '', False, False, 0, 'GenServer'),
        (2, 'Shop.Tree', 'use', 2, 'module', '', False, False, 0, 'Supervisor'),
    ]),
    "attributes": ("file_id BIGINT, module VARCHAR, name VARCHAR, line INTEGER, values INTEGER, value VARCHAR, text VARCHAR, attribute_kind VARCHAR", [
        (1, 'Shop.Store', 'behaviour', 8, 1, 'Shop.Backend', '@behaviour Shop.Backend', 'behaviour'),
        (1, 'Shop.Store', 'doc', 16, 1, 'Fetches one.', '@doc Fetches one.', 'documentation'),
        (1, 'Shop.Store', 'impl', 28, 1, 'true', '@impl true', 'impl'),
        (1, 'Shop.Store', 'limit', 11, 1, '10', '@limit 10', 'attribute'),
        (1, 'Shop.Store', 'limit', 17, 0, '', '@limit ', 'attribute'),
        (1, 'Shop.Store', 'moduledoc', 2, 1, 'Keeps the stock.', '@moduledoc Keeps the stock.', 'documentation'),
        (1, 'Shop.Store', 'spec', 15, 1, 'fetch(key, integer)::row', '@spec fetch(key, integer)::row', 'spec'),
        (1, 'Shop.Store', 'type', 9, 1, 'key(a)::{a, integer}', '@type key(a)::{a, integer}', 'type'),
        (1, 'Shop.Store', 'typep', 10, 1, 'row::map', '@typep row::map', 'type'),
    ]),
    "types": ("file_id BIGINT, module VARCHAR, name VARCHAR, arity INTEGER, visibility VARCHAR, line INTEGER", [
        (1, 'Shop.Store', 'key', 1, 'type', 9),
        (1, 'Shop.Store', 'row', 0, 'typep', 10),
    ]),
    "specs": ("file_id BIGINT, module VARCHAR, spec_kind VARCHAR, name VARCHAR, line INTEGER", [
        (1, 'Shop.Store', 'spec', 'fetch', 15),
    ]),
    "control_flow": ("file_id BIGINT, module VARCHAR, fun VARCHAR, fun_arity INTEGER, construct VARCHAR, line INTEGER, position INTEGER", [
        (1, 'Shop.Store', 'build', 1, 'with', 33, 0),
        (1, 'Shop.Store', 'fetch', 2, 'case', 20, 0),
        (2, 'Shop.Priced.Shop.Item', 'price', 1, 'if', 16, 0),
    ]),
    "exceptions": ("file_id BIGINT, module VARCHAR, fun VARCHAR, fun_arity INTEGER, construct VARCHAR, line INTEGER", [
        (1, 'Shop.Store', 'fetch', 2, 'raise', 21),
        (1, 'Shop.Store', 'fetch', 2, 'throw', 26),
    ]),
    "structs": ("file_id BIGINT, module VARCHAR, definer VARCHAR, fields VARCHAR[], line INTEGER", [
        (1, 'Shop.Store', 'defstruct', ['name', 'stock'], 13),
        (1, 'Shop.Store.Error', 'defexception', ['message'], 37),
    ]),
    "protocols": ("file_id BIGINT, protocol VARCHAR, implementation BOOLEAN, for_type VARCHAR, line INTEGER", [
        (2, 'Shop.Priced', False, '', 11),
        (2, 'Shop.Priced', True, 'Shop.Item', 15),
    ]),
    "behaviours": ("file_id BIGINT, module VARCHAR, behaviour VARCHAR", [
        (1, 'Shop.Store', 'GenServer'),
        (1, 'Shop.Store', 'Shop.Backend'),
        (2, 'Shop.Tree', 'Supervisor'),
    ]),
    "process_callbacks": ("file_id BIGINT, module VARCHAR, behaviour VARCHAR, name VARCHAR, arity INTEGER, line INTEGER", [
        (1, 'Shop.Store', 'GenServer', 'init', 1, 29),
        (2, 'Shop.Tree', 'Supervisor', 'init', 1, 4),
    ]),
    "anonymous_functions": ("file_id BIGINT, module VARCHAR, fun VARCHAR, fun_arity INTEGER, kind VARCHAR, line INTEGER, position INTEGER", [
        (1, 'Shop.Store', 'build', 1, 'capture', 33, 2),
        (1, 'Shop.Store', 'build', 1, 'fn', 32, 1),
        (1, 'Shop.Store', 'fetch', 2, 'fn', 19, 0),
    ]),
    "free_variables": ("file_id BIGINT, module VARCHAR, fun VARCHAR, line INTEGER, name VARCHAR, uses BIGINT", [
        (1, 'Shop.Store', 'build', 32, 'args', 1),
        (1, 'Shop.Store', 'build', 32, 'name', 1),
        (1, 'Shop.Store', 'fetch', 19, 'key', 2),
        (1, 'Shop.Store', 'fetch', 19, 'most', 1),
    ]),
    "quotes": ("file_id BIGINT, module VARCHAR, fun VARCHAR, construct VARCHAR, line INTEGER, depth INTEGER", [
        (1, 'Shop.Store.Error', 'wrap', 'quote', 38, 6),
        (1, 'Shop.Store.Error', 'wrap', 'unquote', 38, 8),
    ]),
    "supervisors": ("file_id BIGINT, module VARCHAR, behaviour VARCHAR, strategy VARCHAR, max_restarts INTEGER, max_seconds INTEGER, line INTEGER, intensity DOUBLE, high BOOLEAN", [
        (2, 'Shop.Tree', 'Supervisor', 'rest_for_one', 7, 2, 7, 3.5, True),
    ]),
    "child_specs": ("file_id BIGINT, module VARCHAR, child VARCHAR, position INTEGER, type VARCHAR, line INTEGER", [
        (2, 'Shop.Tree', 'Shop.Cache', 1, 'worker', 6),
        (2, 'Shop.Tree', 'Shop.DeepSupervisor', 2, 'supervisor', 6),
        (2, 'Shop.Tree', 'Shop.Store', 0, 'worker', 6),
    ]),
    "ets_tables": ("file_id BIGINT, module VARCHAR, fun VARCHAR, table VARCHAR, type VARCHAR, access VARCHAR, named BOOLEAN, read_concurrency BOOLEAN, write_concurrency BOOLEAN, line INTEGER", [
        (1, 'Shop.Store', 'fetch', 'stock', 'set', 'public', True, False, False, 18),
    ]),
    "macro_invocations": ("file_id BIGINT, module VARCHAR, fun VARCHAR, macro VARCHAR, library VARCHAR, arity INTEGER, line INTEGER, position INTEGER", [
        (1, 'Shop.Store', 'build', 'defp', 'Kernel', 2, 31, 0),
        (1, 'Shop.Store', 'fetch', 'def', 'Kernel', 2, 17, 0),
        (1, 'Shop.Store', 'fetch', 'def', 'Kernel', 2, 26, 1),
        (1, 'Shop.Store', 'fetch', 'raise', 'Kernel', 2, 21, 0),
        (1, 'Shop.Store', 'init', 'def', 'Kernel', 2, 29, 2),
        (1, 'Shop.Store', None, 'alias', 'Kernel', 1, 5, 0),
        (1, 'Shop.Store', None, 'alias', 'Kernel', 2, 6, 1),
        (1, 'Shop.Store', None, 'defmodule', 'Kernel', 2, 1, 0),
        (1, 'Shop.Store', None, 'defstruct', 'Kernel', 1, 13, 0),
        (1, 'Shop.Store', None, 'import', 'Kernel', 2, 7, 0),
        (1, 'Shop.Store', None, 'require', 'Kernel', 1, 4, 0),
        (1, 'Shop.Store', None, 'use', 'Kernel', 1, 3, 0),
        (1, 'Shop.Store.Error', 'wrap', 'defmacro', 'Kernel', 2, 38, 0),
        (1, 'Shop.Store.Error', None, 'defmodule', 'Kernel', 2, 36, 0),
        (2, 'Shop.Priced', 'price', 'def', 'Kernel', 1, 12, 0),
        (2, 'Shop.Priced.Shop.Item', 'price', 'def', 'Kernel', 2, 16, 0),
        (2, 'Shop.Priced.Shop.Item', 'price', 'if', 'Kernel', 2, 16, 0),
        (2, 'Shop.Tree', 'init', 'Logger.info', 'Logger', 1, 5, 0),
        (2, 'Shop.Tree', 'init', 'def', 'Kernel', 2, 4, 0),
        (2, 'Shop.Tree', None, 'defmodule', 'Kernel', 2, 1, 0),
        (2, 'Shop.Tree', None, 'use', 'Kernel', 1, 2, 0),
    ]),
    "parse_errors": ("file_id BIGINT, path VARCHAR, message VARCHAR, line INTEGER", [
        (3, 'lib/broken.ex', 'missing terminator: )', 4),
    ]),
}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def stated_sql(name: str) -> str:
    """The stated rows as a query."""
    columns, rows = STATED[name]
    typed = [c.rsplit(" ", 1) for c in columns.split(", ")]
    names = ", ".join(f'"{c}"' for c, _ in typed)
    return "SELECT " + ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in typed) + " FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({names})"
