"""``python -m bedcensus SF_DIR OUT_DIR [options]`` runs the variants job."""

from bedcensus.plans.job import main

if __name__ == "__main__":
    main()
