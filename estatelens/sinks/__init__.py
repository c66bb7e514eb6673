"""Writers of whole tables with a commit step."""
