"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Conventions shared by
every operator in it:

* an operator reads only the columns it names; other columns, also ones whose
  names clash with an output or differ from an input only by case, are ignored;
* a null text counts as an empty text, a null id is kept and sorts first;
* repeated rows stay repeated rows, an empty table gives an empty result with
  the same schema;
* whole texts are processed, whatever their length.
"""
