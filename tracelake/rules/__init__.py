"""Rule packs: data only."""
