from claimweave.plans.runner import main

raise SystemExit(main())
