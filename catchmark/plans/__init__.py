"""The five analyses, each a composition of operators; results stay lazy until written."""
