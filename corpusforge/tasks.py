"""Ready-made tables and tasks. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.functions import responses as R
from corpusforge.functions.numbers import fmt_fixed, fmt_thousands, trim_all
from corpusforge.spec import BINARY, MULTICLASS, REGRESSION, TableSpec, TaskSpec, register

# Sentence frames shared by all instructions.
ANSWER_LINE = (
    "At the very end of your reasoning, on a separate line, output exactly:\n"
    "Prediction is <value>.\n"
    "where <value> {domain}.\n"
    "{meaning}"
    "Do not add any other text after this line.\n\n"
)
PLAIN_FRAME = "You are {role}. Based on {features}, {goal}. Please explain your reasoning.\n\n"
DEPTH_FRAME = "You are {role}. Based on {features_90s}, conduct in-depth qualitative analysis to {goal_deep}. "
STEPS = (
    "Reasoning format:\n"
    "(1). Self feature-based reasoning:\n"
    "(2). Global statistics-based reasoning{across}:\n"
    "(3). Similar-cases reasoning:\n"
    "(4). Final Resolution:\n"
)
USE_CONTEXT = (
    "You should use dataset statistics and similar historical cases to assist your reasoning. "
    "Please explain your reasoning in the following way.\n\n"
)
GIVEN_CONTEXT = (
    "You are also provided with dataset statistics and similar historical cases to assist your reasoning. "
    "Please explain your reasoning in the following way.\n\n"
)
WHY_FRAME = "You are {role}. Based on {features_90s}, explain why THE GIVEN PREDICTION LABEL for {subject} is plausible{legend}.\n\n"
WHY_DEEP_FRAME = (
    "You are {role}. Based on {features_90s}, conduct in-depth qualitative analysis to explain why "
    "THE GIVEN PREDICTION LABEL for {subject} is plausible{legend}. "
)


def instructions(
    role: str, features: str, goal: str, subject: str, domain: str, meaning: str = "", legend: str = "",
    goal_deep: str | None = None, features_90s: str | None = None, across: str = "",
) -> dict[str, str]:
    """Instruction texts of the four modes from one set of words."""
    words = dict(
        role=role, features=features, goal=goal, subject=subject, legend=legend,
        goal_deep=goal_deep or goal, features_90s=features_90s or features,
    )
    end = ANSWER_LINE.format(domain=domain, meaning=meaning)
    steps = STEPS.format(across=across)
    return {
        "zeroshot": PLAIN_FRAME.format(**words) + end,
        "reasoning": DEPTH_FRAME.format(**words) + USE_CONTEXT + steps + end,
        "finetune": WHY_DEEP_FRAME.format(**words) + GIVEN_CONTEXT + steps + end,
        "normal_finetune": WHY_FRAME.format(**words) + end,
    }


def yes_no_target(text: Column) -> Column:
    """1 for yes, 0 for anything else, NULL included."""
    return F.when(F.lower(text) == "yes", 1).otherwise(0)


def label_ids(labels: list[str], normalise) -> tuple:
    """Label to id and id to label; unknown ids and texts render as the first label."""

    def to_target(text: Column) -> Column:
        known, out = normalise(text.cast("string")), F.lit(None).cast("int")
        for i, label in enumerate(labels):
            out = F.when(known == label, i).otherwise(out)
        return out

    def from_target(target: Column) -> Column:
        text = target.cast("string")
        number = text.try_cast("double")
        out = normalise(text)
        for i, label in enumerate(labels):
            out = F.coalesce(out, F.when(number == i, label))
        return F.coalesce(out, F.lit(labels[0]))

    return to_target, from_target


def multiclass_task(labels: list[str], normalise, token: str, sentence, texts: dict[str, str]) -> TaskSpec:
    to_target, from_target = label_ids(labels, normalise)
    return TaskSpec(
        render_target=from_target,
        parse=lambda final: R.parse_class(final, token, normalise),
        to_target=to_target,
        from_target=from_target,
        sentence=lambda y: sentence(from_target(y)),
        instructions=texts,
    )


def numeric_task(digits: int, sentence, texts: dict[str, str] | None = None) -> TaskSpec:
    return TaskSpec(
        render_target=lambda y: fmt_fixed(y.cast("double"), digits),
        parse=R.parse_numeric,
        to_target=lambda text: F.trim(text.cast("string")).try_cast("double"),
        from_target=lambda y: y.cast("double"),
        sentence=sentence,
        instructions=texts or {},
    )


def default_sentence(y: Column, task: str | None = None, numeric: bool = False) -> Column:
    """Sentence for tables without their own wording."""
    if not numeric:
        lead = "The label is: "
    elif task == "classification":
        lead = "The label for this case is: "
    else:
        lead = "The target value is: "
    return F.concat(F.lit(lead), y.cast("string"))


def choose(test, yes: str, no: str):
    return lambda y: F.when(F.coalesce(test(y), F.lit(False)), yes).otherwise(no)


def income_positive(y: Column) -> Column:
    text = F.lower(trim_all(y.cast("string")))
    return text.isin(">50k", "yes", "1", "true") | (text.try_cast("double") > 0)


def default_positive(y: Column) -> Column:
    text = F.lower(trim_all(y.cast("string")))
    return text.isin("1", "yes", "true", "default") | (F.floor(text.try_cast("double")) == 1)


# Labels, columns, descriptions and wording of the known tables.
JOB_LABELS = ["non_stem", "stem", "student"]
READMISSION_LABELS = ["NO", ">30", "<30"]
JOB_TOKEN = r"a-zA-Z_\-\s"
READMISSION_TOKEN = r"a-zA-Z0-9_\-<>\s"

register(
    TableSpec(
        name="adult",
        target="income",
        task=BINARY,
        cat_cols=(
            "marital-status", "occupation", "gender", "relationship", "workclass", "race", "native-country", "education",
        ),
        num_cols=("age", "capital-gain", "educational-num", "hours-per-week", "capital-loss", "fnlwgt"),
        descriptions={
            "marital-status": "Marital status",
            "age": "Age",
            "capital-gain": "Capital gain",
            "educational-num": "Education level (numeric)",
            "occupation": "Occupation",
            "hours-per-week": "Hours worked per week",
            "capital-loss": "Capital loss",
            "gender": "Gender",
            "relationship": "Relationship status",
            "fnlwgt": "Final weight (census sampling weight)",
            "workclass": "Work class",
            "race": "Race",
            "native-country": "Native country",
            "education": "Highest education level",
        },
    ),
    TaskSpec(
        render_target=choose(lambda y: y.cast("string") == ">50K", "yes", "no"),
        parse=R.parse_yes_no,
        to_target=yes_no_target,
        from_target=choose(lambda y: y.cast("string").isin("1", "1.0", ">50K"), "yes", "no"),
        sentence=choose(income_positive, "This person has income > $50K.", "This person has income ≤ $50K."),
        binarize=choose(income_positive, "1", "0"),
        instructions=instructions(
            role="an income classifier",
            features="the following census features from 1990s below",
            features_90s="the following census features from the 1990s",
            goal="predict whether this person's annual income exceeds $50K",
            subject="this person's income",
            domain="is either yes or no",
            meaning="yes means income > $50K; no means income <= $50K.\n",
            legend=" (yes means income > $50K; no means income <= $50K)",
        ),
    ),
)
register(
    TableSpec(
        name="california",
        target="median_house_value",
        task=REGRESSION,
        cat_cols=("ocean_proximity",),
        num_cols=(
            "latitude", "longitude", "median_income", "total_rooms", "total_bedrooms", "population", "households",
            "housing_median_age",
        ),
        descriptions={
            "latitude": "Latitude",
            "longitude": "Longitude",
            "median_income": "Median income for households within a block of houses (measured in tens of thousands of US Dollars)",
            "total_rooms": "Total number of rooms within a block",
            "ocean_proximity": "Location of the house w.r.t ocean/sea.",
            "total_bedrooms": "Total number of bedrooms within a block",
            "population": "Total number of people residing within the block",
            "households": "Total number of households, a group of people residing within a home unit, for a block",
            "housing_median_age": "Median age of houses in the block",
        },
        text_by_features=True,
    ),
    numeric_task(
        4,
        lambda y: F.concat(F.lit("The median house value for this area is $"), fmt_fixed(y.cast("double"), 0), F.lit(".")),
        instructions(
            role="a house price estimator",
            features="the following housing and geographic features in California",
            goal="predict the median house value in US Dollars for this area",
            subject="this area's median house value in US Dollars",
            domain="is the predicted median house value in US Dollars as a numeric value",
            across=" across the value distribution",
        ),
    ),
)
register(
    TableSpec(
        name="diamonds",
        target="price",
        task=REGRESSION,
        cat_cols=("clarity", "color", "cut"),
        num_cols=("carat", "y", "x", "z", "depth", "table"),
        descriptions={
            "carat": "Weight of the diamond (0.2-5.01 carats)",
            "y": "Width in mm (0-58.9)",
            "clarity": "Measurement of how clear the diamond is. Ordered from worst to best: I1, SI2, SI1, VS2, VS1, VVS2, VVS1, IF",
            "color": "Diamond color grade. Ordered from worst to best: J, I, H, G, F, E, D",
            "x": "Length in mm (0-10.74)",
            "z": "Depth in mm (0-31.8).",
            "depth": "Total depth percentage = z / mean(x, y) = 2 * z / (x + y) (43-79)",
            "cut": "Quality of the cut. Ordered from worst to best: Fair, Good, Very Good, Premium, Ideal",
            "table": "Width of top of diamond relative to widest point (43-95)",
        },
        text_by_features=True,
    ),
    numeric_task(
        2,
        lambda y: F.concat(F.lit("The price of this diamond is $"), fmt_thousands(y), F.lit(".")),
        instructions(
            role="a diamond price estimator",
            features="the following diamond characteristics",
            goal="predict the price of this diamond in US Dollars",
            subject="this diamond price in US Dollars",
            domain="is the predicted diamond price in US Dollars as a numeric value",
            across=" across the value distribution",
        ),
    ),
)
register(
    TableSpec(
        name="home_credit",
        target="TARGET",
        task=BINARY,
        label_display={"0": "non_default", "1": "default"},
        cat_cols=(
            "CODE_GENDER", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "FLAG_OWN_CAR", "ORGANIZATION_TYPE", "FLAG_DOCUMENT_3",
        ),
        num_cols=(
            "EXT_SOURCE_3", "EXT_SOURCE_2", "AMT_GOODS_PRICE", "EXT_SOURCE_1", "AMT_CREDIT", "DAYS_EMPLOYED", "DAYS_BIRTH",
            "AMT_ANNUITY", "DAYS_ID_PUBLISH",
        ),
        descriptions={
            "EXT_SOURCE_3": "External risk score 3 (normalized).",
            "EXT_SOURCE_2": "External risk score 2 (normalized).",
            "AMT_GOODS_PRICE": "Price of goods for which the loan is requested.",
            "EXT_SOURCE_1": "External risk score 1 (normalized).",
            "AMT_CREDIT": "Loan credit amount requested.",
            "DAYS_EMPLOYED": "Days employed before application (relative days).",
            "CODE_GENDER": "Client gender.",
            "NAME_EDUCATION_TYPE": "Highest education level achieved.",
            "DAYS_BIRTH": "Client age in days at application (relative days).",
            "AMT_ANNUITY": "Loan annuity amount.",
            "OCCUPATION_TYPE": "Client occupation type.",
            "FLAG_OWN_CAR": "Whether the client owns a car (Y/N).",
            "DAYS_ID_PUBLISH": "Days since ID document update before application.",
            "ORGANIZATION_TYPE": "Type of organization where client works.",
            "FLAG_DOCUMENT_3": "Whether document #3 was provided (0/1).",
        },
    ),
    TaskSpec(
        render_target=choose(default_positive, "yes", "no"),
        parse=R.parse_yes_no_or_digit,
        to_target=yes_no_target,
        from_target=choose(default_positive, "yes", "no"),
        sentence=choose(
            default_positive, "This applicant will default on the loan.", "This applicant will not default on the loan."
        ),
        instructions=instructions(
            role="a credit risk classifier",
            features="the following applicant and loan features",
            goal="predict whether the applicant will default on the loan",
            subject="this applicant's default risk",
            domain="is either yes or no",
            meaning="yes means the applicant is likely to default; no means the applicant is not likely to default.\n",
            legend=" (yes means the applicant is likely to default; no means the applicant is not likely to default)",
        ),
    ),
)
register(
    TableSpec(
        name="okcupid_stem",
        target="job",
        task=MULTICLASS,
        cat_cols=(
            "education", "sex", "location", "sign", "religion", "speaks", "orientation", "body_type", "ethnicity", "drinks",
            "offspring", "smokes", "pets", "status", "diet", "drugs",
        ),
        num_cols=("age", "income", "height"),
        description_order=True,
        descriptions={
            "education": "Education status/level.",
            "age": "Age in years.",
            "sex": "Sex.",
            "income": "Annual income (may be missing).",
            "location": "Location string.",
            "sign": "Astrological sign.",
            "religion": "Religion and seriousness.",
            "speaks": "Languages spoken.",
            "orientation": "Sexual orientation.",
            "body_type": "Self-reported body type.",
            "ethnicity": "Self-reported ethnicity.",
            "drinks": "Drinking habits.",
            "height": "Height (inches).",
            "offspring": "Children/offspring preference/status.",
            "smokes": "Smoking habits.",
            "pets": "Pet preference.",
            "status": "Relationship status.",
            "diet": "Diet preference.",
            "drugs": "Drug-use habits.",
        },
    ),
    multiclass_task(
        JOB_LABELS,
        lambda v: R.normalize_class(v, JOB_LABELS),
        JOB_TOKEN,
        lambda label: F.concat(F.lit("This profile belongs to job category: "), label, F.lit(".")),
        instructions(
            role="a job-type classifier",
            features="the following profile features",
            goal="predict the job category of the person",
            goal_deep="predict the person's job category",
            subject="this person's job category",
            domain="must be one of: non_stem, stem, student",
            meaning="non_stem means a non-STEM job; stem means a STEM job; student means a student.\n",
            legend=(
                " (valid labels are: non_stem, stem, student; non_stem means a non-STEM job, stem means a STEM job, "
                "student means a student)"
            ),
        ),
    ),
)
register(
    TableSpec(
        name="diabetes_130US",
        target="readmitted",
        task=MULTICLASS,
        cat_cols=(
            "discharge_disposition_id", "diag_1", "age", "diabetesMed", "medical_specialty", "admission_source_id",
            "admission_type_id", "diag_2",
        ),
        num_cols=(
            "number_inpatient", "number_diagnoses", "time_in_hospital", "num_lab_procedures", "num_medications",
            "number_outpatient", "num_procedures",
        ),
        descriptions={
            "discharge_disposition_id": "Discharge destination/status code from this encounter.",
            "number_inpatient": "Number of inpatient admissions in the previous year.",
            "number_diagnoses": "Total number of diagnosis codes recorded in this encounter.",
            "diag_1": "Primary diagnosis group/category for this encounter.",
            "age": "Patient age group bucket (<30, 30-60, >60 in this processed dataset).",
            "diabetesMed": "Whether any diabetes medication was prescribed (Yes/No).",
            "medical_specialty": "Admitting physician specialty (or 'missing' when unknown).",
            "time_in_hospital": "Length of stay for this encounter in days.",
            "num_lab_procedures": "Number of laboratory procedures performed during this encounter.",
            "admission_source_id": "Admission source code (for example physician referral, ER, transfer).",
            "num_medications": "Number of distinct medications prescribed during this encounter.",
            "admission_type_id": "Admission type code (for example emergency, urgent, elective).",
            "number_outpatient": "Number of outpatient visits in the previous year.",
            "num_procedures": "Number of non-laboratory procedures performed during this encounter.",
            "diag_2": "Secondary diagnosis group/category for this encounter.",
        },
    ),
    multiclass_task(
        READMISSION_LABELS,
        lambda v: R.normalize_exact(v, READMISSION_LABELS),
        READMISSION_TOKEN,
        lambda label: F.when(label == "<30", "This patient is readmitted within 30 days.")
        .when(label == ">30", "This patient is readmitted after 30 days.")
        .otherwise("This patient has no readmission."),
        instructions(
            role="a hospital readmission classifier",
            features="the following patient encounter features",
            goal="predict the readmission category for this patient",
            subject="this patient's readmission category",
            domain="must be one of: NO, >30, <30",
            meaning="NO means no readmission; >30 means readmitted after 30 days; <30 means readmitted within 30 days.\n",
            legend=(
                " (valid labels are: NO, >30, <30; NO means no readmission, >30 means readmitted after 30 days, "
                "<30 means readmitted within 30 days)"
            ),
        ),
    ),
)
