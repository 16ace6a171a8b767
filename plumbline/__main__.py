"""``python -m plumbline STAGE --flags``: one stage of a run, from files to files."""

from plumbline.plans.commands import main

raise SystemExit(main())
