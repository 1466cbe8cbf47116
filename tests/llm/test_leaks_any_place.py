import pyarrow as pa
import pytest

from tidewake.llm import decontaminate

SHORT = "Janet walks by the old river"
ITEM = "Janet buys 12 kg of green stone for 30 dollars and walks slow north in winter light"


def kinds(item, *texts):
    index = decontaminate.Index([1], [item], decontaminate.WINDOW, decontaminate.LITERALS, decontaminate.SHORT_LITERALS)
    t = decontaminate.Template(pa.array(texts))
    got = {text: index.best(t, item, hits) for (text, item), hits in index.matches(t).items()}
    return [None if not got.get(i) else "verbatim" if got[i][2] else "reparameterised" for i in range(len(texts))]


@pytest.mark.parametrize("item", [SHORT, ITEM, "Tiny house of 3 rooms by the old river Po"])
def test_verbatim_in_any_place_and_capitals(item):
    texts = [f"so the word {item} and on", f"So. {item}", item.upper(), f"x {item.title()} y", f"x {item.lower()} y"]
    assert kinds(item, *texts) == ["verbatim"] * len(texts)


def test_first_name_may_change():
    other = ITEM.replace("Janet", "Peter").replace("12", "7")
    assert kinds(ITEM, f"so the word {other} and on", f"So. {other}", ITEM.replace("green stone", "red wood")) == ["reparameterised", "reparameterised", None]
    # the first name is one name throughout
    item = "Janet buys 12 kg of green stone for 30 dollars and walks slow north with Janet"
    assert kinds(item, item.replace("Janet", "Peter")) == ["reparameterised"]
