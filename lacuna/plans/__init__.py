"""Rule packs and the plans that are built from the operators."""
