"""Coding of mortality records: readable categories, numeric codes and the preset spec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinprofile.functions.scalar import band, coded_in, lookup, stripped
from kinprofile.spec import FeatureSpec, Nominal, Ordinal

# The coding of the public mortality records and the labels of its categories.
HOMICIDE_CODES = [f"X{n}" for n in range(85, 100)] + [f"Y0{n}" for n in range(10)]

STATES = ["AC", "AM", "AP", "MA", "MT", "PA", "RO", "RR", "TO"]
YEARS = [str(y) for y in range(2013, 2024)]

WANTED_COLUMNS = [
    "DTOBITO", "HORAOBITO", "DTNASC", "IDADE", "SEXO", "RACACOR", "ESTCIV", "ESC",
    "LOCOCOR", "GRAVIDEZ", "CAUSABAS_O", "ANO", "ESTADO",
]

SEX_CATEGORY = {
    "1": "masculino", "M": "masculino", "masculino": "masculino",
    "2": "feminino", "F": "feminino", "feminino": "feminino",
    "0": "nao_decl", "I": "nao_decl", "ignorado": "nao_decl",
}
RACE_CATEGORY = {
    "1": "branca", "branca": "branca",
    "2": "preta", "preta": "preta",
    "3": "amarela", "amarela": "amarela",
    "4": "parda", "parda": "parda",
    "5": "indigena", "indigena": "indigena",
    "0": "nao_decl", "": "nao_decl",
}
MARITAL_CATEGORY = {
    "1": "solteiro", "solteiro": "solteiro",
    "2": "com_vinculo", "casado": "com_vinculo",
    "5": "com_vinculo", "união estável": "com_vinculo",
    "3": "vinculo_encerrado", "viuvo": "vinculo_encerrado",
    "4": "vinculo_encerrado", "separado": "vinculo_encerrado",
    "9": "ignorado", "ignorado": "ignorado", "0": "ignorado", "": "ignorado",
}
SCHOOL_CATEGORY = {
    "1": "sem_escolaridade", "nenhuma": "sem_escolaridade",
    "2": "fundamental", "1 a 3 anos": "fundamental",
    "3": "fundamental", "4 a 7 anos": "fundamental",
    "4": "medio", "8 a 11 anos": "medio",
    "5": "superior", "12 anos e mais": "superior",
    "9": "ignorado", "ignorado": "ignorado", "0": "ignorado", "": "ignorado",
}
PLACE_CATEGORY = {
    "1": "estab_saude", "hospital": "estab_saude",
    "2": "estab_saude", "outros estabelecimentos de saude": "estab_saude",
    "3": "domicilio", "domicílio": "domicilio",
    "4": "local_publico", "via pública": "local_publico",
    "5": "outros", "outros": "outros",
    "9": "ignorado", "ignorado": "ignorado", "0": "ignorado", "": "ignorado",
}

SEX_NUMBER = {"1": 1, "2": 2, "0": 0, "": 0, "M": 1, "F": 2, "I": 0, "masculino": 1, "feminino": 2, "ignorado": 0}
RACE_NUMBER = {
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "": 0,
    "branca": 1, "preta": 2, "amarela": 3, "parda": 4, "indigena": 5,
}
MARITAL_NUMBER = {
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "9": 0, "": 0,
    "solteiro": 1, "casado": 2, "viuvo": 3, "separado": 4, "união estável": 5, "ignorado": 0,
}
SCHOOL_NUMBER = {
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "9": 0, "0": 0, "": 0,
    "nenhuma": 1, "1 a 3 anos": 2, "4 a 7 anos": 3, "8 a 11 anos": 4, "12 anos e mais": 5, "ignorado": 0,
}
PLACE_NUMBER = {
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "9": 0, "": 0,
    "hospital": 1, "outros estabelecimentos de saude": 2, "domicílio": 3, "via pública": 4, "outros": 5, "ignorado": 0,
}

DISPLAY_LABELS = {
    "SEXO_NUM": {1: "Masculino", 2: "Feminino", 0: "Ignorado"},
    "RACACOR_NUM": {1: "Branca", 2: "Preta", 3: "Amarela", 4: "Parda", 5: "Indígena", 0: "Ignorado"},
    "ESTCIV_NUM": {1: "Solteiro", 2: "Casado", 3: "Viúvo", 4: "Separado", 5: "União Estável", 0: "Ignorado"},
    "ESC_NUM": {
        1: "Nenhuma", 2: "1 a 3 anos", 3: "4 a 7 anos", 4: "8 a 11 anos", 5: "12 anos e mais", 0: "Ignorado",
    },
    "LOCOCOR_NUM": {
        1: "Hospital", 2: "Outros Estab. Saúde", 3: "Domicílio", 4: "Via Pública", 5: "Outros", 0: "Ignorado",
    },
}

AGE_BANDS = [(1, "recem_nascido"), (12, "crianca"), (18, "adolescente"), (30, "jovem_adulto"), (60, "adulto")]
SHIFTS = [(6, "madrugada"), (12, "manha"), (18, "tarde"), (24, "noite")]

MISSING_TOKENS = ["", "nan", "none", "<na>"]
IGNORED_CODES = {
    "SEXO": ["0", "I", "ignorado", "nao_decl"],
    "RACACOR": [],
    "ESTCIV": ["9", "ignorado"],
    "ESC": ["9", "ignorado"],
    "LOCOCOR": ["9", "ignorado"],
}
# End of fixed values.


def plain_number(text: Column) -> Column:
    """A decimal number between white space; suffixes such as the D of "425D", which casts accept, make it null."""
    bare = stripped(text)
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare).try_cast("double")


def age_digits(code: Column) -> Column:
    """The code as the digits of a whole number.

    Passing through a number loses a leading zero: "015" reads as unit 1, quantity 5.
    """
    return plain_number(code).try_cast("bigint").cast("string")


def years_from_digits(digits: Column) -> Column:
    """Age in years: the first digit is the unit, the rest the quantity.

    Unknown units, one-digit and non-numeric codes give null.
    """
    quantity = F.substring(digits, 2, 20).try_cast("double")
    per_year = F.element_at(
        F.create_map(*[F.lit(x) for x in ("4", 1.0, "3", 12.0, "2", 365.0, "1", 8760.0)]),
        F.substring(digits, 1, 1),
    )
    return F.when(F.length(digits) >= 2, quantity / per_year)


def age_years(code: Column) -> Column:
    return years_from_digits(age_digits(code))


def age_band(years: Column) -> Column:
    return band(years, AGE_BANDS, "idoso", "ignorado")


def raw_hour(code: Column) -> Column:
    """Leading two characters as a number, null when they are not one."""
    return plain_number(F.substring(code, 1, 2))


def shift(hour: Column) -> Column:
    """Part of the day; null and hours outside 0-23 are "ignorado"."""
    whole = hour.cast("int")
    inside = F.when((whole >= 0) & (whole <= 23), whole)
    return band(inside, SHIFTS[:-1], SHIFTS[-1][1], "ignorado")


def decode(df: DataFrame) -> DataFrame:
    """Add age in years and valid hour.

    The parts that several later expressions read are columns of their own, so they are
    computed once per row and the generated code stays small enough to be compiled.
    """
    if "IDADE_NUM" in df.columns:
        return df
    return (
        df.withColumns({"_digits": age_digits(F.col("IDADE")), "_hour": raw_hour(F.col("HORAOBITO"))})
        .withColumns({
            "IDADE_NUM": years_from_digits(F.col("_digits")),
            "HORA_NUM": F.when(F.col("_hour").between(0, 23), F.col("_hour")),
        })
        .drop("_digits", "_hour")
    )


def categorise(df: DataFrame) -> DataFrame:
    """Add the seven readable category columns (and the two decoded numbers they need)."""
    return decode(df).withColumns({
        "FAIXA_IDADE": age_band(F.col("IDADE_NUM")),
        "TURNO_HORA": shift(F.col("HORA_NUM")),
        "CAT_SEXO": lookup(F.col("SEXO"), SEX_CATEGORY, "nao_decl"),
        "CAT_RACA": lookup(F.col("RACACOR"), RACE_CATEGORY, "nao_decl"),
        "CAT_LOCOCOR": lookup(F.col("LOCOCOR"), PLACE_CATEGORY, "ignorado"),
        "CAT_ESC": lookup(F.col("ESC"), SCHOOL_CATEGORY, "ignorado"),
        "CAT_ESTCIV": lookup(F.col("ESTCIV"), MARITAL_CATEGORY, "ignorado"),
    })


def describe_numeric(df: DataFrame) -> DataFrame:
    """Add the numeric descriptive columns and the 0/1 homicide flag."""
    return decode(df).withColumns({
        "HOMICIDIO": coded_in(F.col("CAUSABAS_O"), HOMICIDE_CODES).cast("int"),
        "SEXO_NUM": lookup(F.col("SEXO"), SEX_NUMBER),
        "RACACOR_NUM": lookup(F.col("RACACOR"), RACE_NUMBER),
        "ESTCIV_NUM": lookup(F.col("ESTCIV"), MARITAL_NUMBER),
        "ESC_NUM": lookup(F.col("ESC"), SCHOOL_NUMBER),
        "LOCOCOR_NUM": lookup(F.col("LOCOCOR"), PLACE_NUMBER),
        "ANO_NUM": stripped(F.col("ANO")).try_cast("int"),
    })


def homicides(df: DataFrame) -> DataFrame:
    """Rows whose underlying cause starts with one of the homicide codes."""
    return df.filter(coded_in(F.col("CAUSABAS_O"), HOMICIDE_CODES))


def mortality_spec(row_id: str = "row_id") -> FeatureSpec:
    """The preset feature specification (only the shift keeps "ignorado" as a column)."""
    return FeatureSpec(
        group="ESTADO",
        row_id=row_id,
        nominals=(
            Nominal("FAIXA_IDADE", tuple(b for _, b in AGE_BANDS) + ("idoso", "ignorado"), "ignorado"),
            Nominal("TURNO_HORA", tuple(s for _, s in SHIFTS) + ("ignorado",)),
            Nominal("CAT_SEXO", ("masculino", "feminino", "nao_decl")),
            Nominal("CAT_RACA", ("branca", "preta", "amarela", "parda", "indigena", "nao_decl")),
            Nominal("CAT_LOCOCOR", ("estab_saude", "domicilio", "local_publico", "outros", "ignorado"), "ignorado"),
        ),
        ordinals=(
            Ordinal("CAT_ESC", (
                ("ignorado", 0), ("sem_escolaridade", 1), ("fundamental", 2), ("medio", 3), ("superior", 4),
            )),
            Ordinal("CAT_ESTCIV", (
                ("ignorado", 0), ("solteiro", 1), ("com_vinculo", 2), ("vinculo_encerrado", 3),
            )),
        ),
    )
