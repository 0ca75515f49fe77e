import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from holdfast.schema import RAW  # noqa: E402
from holdfast.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=8, app="tests")
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


# Customers of our own for values that can be worked out by hand: one without a phone,
# one older with nearly everything, one without internet, one with little on fiber.
# The column names are those of the raw file.
PEOPLE = list(RAW.fieldNames())
ONLINE = ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")


def person(key, gender, senior, household, tenure, phone, internet, bought, contract, paperless, payment, bill, total, left):
    """A raw record; ``bought``: the online services that say Yes."""
    online = {c: "No internet service" if internet == "No" else "Yes" if c in bought else "No" for c in ONLINE}
    cells = {
        "customerID": key, "gender": gender, "SeniorCitizen": senior, "Partner": household[0], "Dependents": household[1],
        "tenure": tenure, "PhoneService": phone[0], "MultipleLines": phone[1], "InternetService": internet, **online,
        "Contract": contract, "PaperlessBilling": paperless, "PaymentMethod": payment, "MonthlyCharges": bill,
        "TotalCharges": total, "Churn": left,
    }
    return tuple(cells[c] for c in PEOPLE)


ROWS = [
    person("P-10", "Male", "No", ("No", "No"), 18, ("No", "No phone service"), "DSL",
           {"OnlineSecurity", "DeviceProtection", "TechSupport", "StreamingMovies"}, "One year", "Yes",
           "Credit card (automatic)", 45.0, 800.0, "No"),
    person("P-11", "Female", "Yes", ("Yes", "Yes"), 36, ("Yes", "Yes"), "Fiber optic",
           {"DeviceProtection", "StreamingTV", "StreamingMovies"}, "Month-to-month", "No", "Electronic check", 99.5, 3500.0, "Yes"),
    person("P-12", "Female", "No", ("No", "Yes"), 5, ("Yes", "No"), "No", set(), "Month-to-month", "Yes",
           "Mailed check", 19.0, 90.0, "No"),
    person("P-13", "Male", "No", ("Yes", "No"), 60, ("Yes", "No"), "Fiber optic", {"OnlineSecurity"}, "Two year", "No",
           "Bank transfer (automatic)", 80.25, 4800.0, "No"),
]


@pytest.fixture(scope="session")
def people(spark):
    kinds = {"tenure": "int", "MonthlyCharges": "double", "TotalCharges": "double"}
    return spark.createDataFrame(ROWS, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in PEOPLE))
