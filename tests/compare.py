"""Row comparison that ignores order."""

import pandas as pd


def same_rows(left: pd.DataFrame, right: pd.DataFrame) -> None:
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    assert len(left) == len(right)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (left, right))
    pd.testing.assert_frame_equal(a, b)
