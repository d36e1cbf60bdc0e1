"""Row-level permissions for very many users (F7): policies instead of users.

A user's customer and centre lists with their modes are compiled to two bitmaps over
numbered customers and centres. Users with the same bitmaps and modes share one policy, so
what a policy sees is worked out once however many users have it.

``policy_totals`` (rows and billing per user) adds invoices up per (customer, centre) and
joins them with the customers each policy lists, never with those it doesn't: an exclude
list is the total less what it names. ``visible`` keeps the invoice rows of one user by two
joins with the names its policy lists.

Bitmaps are kept in words of 64 numbers (``tramo``), a BIGINT a word, and words without a
number are left out, so a list of a few customers is a few rows of 8 bytes however many
customers there are.

Defined results: a superuser, and a user without lists, see everything; an include list
that names no known customer or centre shows nothing, an exclude list that names none hides
nothing; a user without a grant sees nothing; names that repeat count once; rows without a
customer are in no customer list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.functions.amounts import MONEY
from arlens.functions.text import strip
from arlens.operators.distinct import word, word_bit
from arlens.operators.scope import INCLUDE
from arlens.scratch import dispose, stored

SCOPES = {"clientes": "c", "centros": "l"}


def numbered_grants(grants: DataFrame, clients: DataFrame, centers: DataFrame) -> DataFrame:
    """``(usuario, ambito, modo, numero)``: every grant with the number of the name it lists, or
    null for unknown names and grants without one, whose ``modo`` is null. ``clients`` and
    ``centers`` are ``(cliente, numero)`` and ``(centro, numero)``."""
    modo = F.when(F.col("valor").isNotNull(), F.col("modo")).alias("modo")
    parts = [grants.filter(F.col("ambito") == scope).select("usuario", "ambito", modo, "valor").join(
        names.select(F.col(col).alias("valor"), "numero"), "valor", "left").drop("valor")
        for scope, names, col in (("clientes", clients, "cliente"), ("centros", centers, "centro"))]
    rest = grants.filter(F.col("ambito").isNull() | ~F.col("ambito").isin(*SCOPES)).select(
        "usuario", "ambito", F.lit(None).cast("string").alias("modo"), F.lit(None).cast("long").alias("numero"))
    return parts[0].unionByName(parts[1]).unionByName(rest)


def numbers_of(masks: DataFrame) -> DataFrame:
    """``masks`` with a row for each number that is set, ``numero``, instead of ``tramo`` and ``mapa``."""
    mapa = F.col("mapa")
    many = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: mapa.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    lone = F.bit_count(mapa) == 1
    bits = F.when(lone & (mapa < 0), F.array(F.lit(63))).when(lone, F.array(F.bit_count(mapa - 1))).otherwise(many)
    return masks.withColumn("_bit", F.explode(bits)).withColumn("numero", F.shiftleft("tramo", 6) + F.col("_bit")).drop("tramo", "mapa", "_bit")


def compile_policies(grants: DataFrame, clients: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, masks, listed): ``users`` is ``(usuario, politica, todo, c_modo, l_modo)``, one row
    a user; ``masks`` is ``(politica, ambito, tramo, mapa)``, the bitmaps of each policy; and
    ``listed`` is ``(politica, ambito, numero)``, the same numbers one by one. The first two are
    stored tables.

    Policies of one SHA-256 of their modes and bitmaps are equal and meet in one, named by the
    first of its users."""
    facts = stored(numbered_grants(grants, clients, centers), "policy-grants")
    # Rows without a number keep their user and mode, in a word of their own that is null. Nobody is no user.
    words = stored(facts.groupBy("usuario", "ambito", F.when(F.col("usuario").isNotNull(), word("numero")).alias("tramo")).agg(
        F.bit_or(word_bit("numero")).alias("mapa"), F.max("modo").alias("modo")), "policy-words")
    dispose(facts)
    # A digest stands for the words of 32,768 numbers: a user has few, whatever the list's length.
    # Rows are dealt by user once, for both of the sums that follow.
    known = F.col("tramo").isNotNull()
    ranges = words.repartition("usuario").groupBy("usuario", "ambito", F.shiftright("tramo", 9).alias("_range")).agg(
        F.max("modo").alias("modo"), F.sha2(F.array_join(F.array_sort(F.collect_list(
            F.when(known, F.concat_ws(":", F.col("tramo").cast("string"), F.hex("mapa"))))), "|"), 256).alias("_digest"))
    users = ranges.groupBy("usuario").agg(
        F.bool_or(F.col("ambito") == "superuser").alias("todo"),
        *[F.max(F.when(F.col("ambito") == scope, F.col("modo"))).alias(f"{p}_modo") for scope, p in SCOPES.items()],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_range").isNotNull(), F.concat_ws(
            ":", "ambito", F.col("_range").cast("string"), "_digest")))), "|").alias("_bits"))
    users = users.withColumn("_print", F.unhex(F.sha2(F.concat_ws(
        "/", F.col("todo").cast("string"), F.coalesce("c_modo", F.lit("-")), F.coalesce("l_modo", F.lit("-")), "_bits"), 256)))
    printed = stored(users.select("usuario", "_print", "todo", "c_modo", "l_modo"), "policy-prints")
    # One user speaks for each policy, so its lists are kept once. Its name is shorter than a digest.
    name = F.coalesce(F.concat(F.lit("="), F.min("usuario")), F.lit("-")).alias("politica")
    users = stored(printed.join(printed.groupBy("_print").agg(name), "_print").select("usuario", "politica", "todo", "c_modo", "l_modo"), "policy-users")
    dispose(printed)
    spoken = users.filter(F.col("politica") == F.concat(F.lit("="), "usuario")).select("usuario", "politica")
    masks = stored(words.filter(known).join(spoken, "usuario").select("politica", "ambito", "tramo", "mapa"), "policy-masks")
    dispose(words)
    return users, masks, numbers_of(masks).select("politica", "ambito", "numero")


def bit_is_set(mapa: Column, numero: Column) -> Column:
    """Whether a bitmap of 32,768 numbers (``bitmap_construct_agg``) holds ``numero``."""
    at = F.bitmap_bit_position(numero)
    byte = F.conv(F.hex(F.substring(mapa, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("long"), F.lit(2)) == 1


def policy_totals(inv: DataFrame, users: DataFrame, masks: DataFrame, listed: DataFrame, clients: DataFrame, centers: DataFrame) -> DataFrame:
    """``(usuario, filas, monto)``: rows and billing each user may see.

    Per policy four sums tell everything: all rows (T), those of its customers (C), of its
    centres (L) and of both (CL). C and L join the policy's lists with totals per customer
    and per centre; CL joins its customers with their centres and keeps those whose bit is
    set in the policy's centre bitmap. Users then take their policy's result.

    Each sum is a stored table, so that only one step's rows are shuffled at a time."""
    cube = inv.groupBy("cliente", strip("linea_negocio").alias("centro")).agg(F.count(F.lit(1)).alias("n"), F.sum("monto_total_ars").alias("m"))
    cube = cube.join(clients.select("cliente", F.col("numero").alias("c")), "cliente", "left").join(
        centers.select("centro", F.col("numero").alias("l")), "centro", "left").select("c", "l", "n", "m")
    cube = stored(cube, "policy-cube")
    whole = cube.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))).scalar()

    def sums(rows: DataFrame, name: str) -> DataFrame:
        return stored(rows.groupBy("politica").agg(F.sum("n").alias(f"{name}_n"), F.sum("m").alias(f"{name}_m")), f"policy-{name}")

    def of(scope: str) -> DataFrame:
        return listed.filter(F.col("ambito") == scope).select("politica", F.col("numero").alias(SCOPES[scope]))

    by_client = cube.filter("c IS NOT NULL").groupBy("c").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    by_center = cube.filter("l IS NOT NULL").groupBy("l").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    # A customer takes the words of its centres to the policies that list it, and back comes the policy's
    # bitmap: the cells themselves, which are many more, are not shuffled with them.
    cells = cube.filter("c IS NOT NULL AND l IS NOT NULL").withColumn("tramo", word("l"))
    lists = stored(of("clientes").join(cells.select("c", "tramo").distinct(), "c").join(
        masks.filter(F.col("ambito") == "centros").select("politica", "tramo", "mapa"), ["politica", "tramo"]), "policy-lists")
    both = lists.join(cells, ["c", "tramo"]).filter(F.col("mapa").bitwiseAND(word_bit("l")) != 0)
    policies = users.select("politica", "todo", "c_modo", "l_modo").distinct()
    parts = [sums(of("clientes").join(by_client, "c"), "c"), sums(of("centros").join(by_center, "l"), "l"), sums(both, "cl")]
    for part in parts:
        policies = policies.join(part, "politica", "left")

    def seen(x: str, total: Column) -> Column:
        c, l, cl = (F.coalesce(F.col(f"{p}_{x}"), F.lit(0)) for p in ("c", "l", "cl"))
        c_in, l_in = F.col("c_modo") == INCLUDE, F.col("l_modo") == INCLUDE
        no_c, no_l = F.col("c_modo").isNull(), F.col("l_modo").isNull()
        return (F.when(F.col("todo") | (no_c & no_l), total).when(no_l, F.when(c_in, c).otherwise(total - c))
                .when(no_c, F.when(l_in, l).otherwise(total - l)).when(c_in & l_in, cl).when(c_in, c - cl).when(l_in, l - cl)
                .otherwise(total - c - l + cl))

    done = stored(policies.select("politica", seen("n", whole["n"]).cast("long").alias("filas"), seen("m", whole["m"]).cast(MONEY).alias("monto")), "policy-totals")
    dispose(cube, lists, *parts)
    return users.join(done, "politica").select("usuario", "filas", "monto")


def visible(inv: DataFrame, users: DataFrame, listed: DataFrame, clients: DataFrame, centers: DataFrame, user: str) -> DataFrame:
    """The invoice rows ``user`` may see, by its policy alone."""
    mine = users.filter(F.col("usuario") == user)
    fact = mine.agg(F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("todo"), F.lit(False)).alias("todo"),
                             F.max("c_modo").alias("clientes"), F.max("l_modo").alias("centros"))).scalar()
    chosen = listed.join(mine.select("politica"), "politica", "left_semi")
    out = inv.withColumn("_centro", strip("linea_negocio"))
    for scope, key, names, col in (("clientes", "cliente", clients, "cliente"), ("centros", "_centro", centers, "centro")):
        hit = chosen.filter(F.col("ambito") == scope).join(names, "numero").select(F.col(col).alias("_v"))
        out = out.join(hit, F.col(key) == F.col("_v"), "left")
        has = F.col("_v").isNotNull()
        out = out.filter(fact["todo"] | fact[scope].isNull() | F.when(fact[scope] == INCLUDE, has).otherwise(~has)).drop("_v")
    return out.filter(fact["n"] > 0).drop("_centro")
