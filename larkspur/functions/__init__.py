"""Values, paths and predicates shared by the plan compilers."""
